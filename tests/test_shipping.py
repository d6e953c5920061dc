from spanforge import shipping


def test_the_package_is_shipped_once(spark):
    shipping._SHIPPED.clear()
    shipping.ship(spark)
    shipping.ship(spark)
    files = [f for f in spark.sparkContext.listFiles if f.endswith("spanforge.zip")]
    assert len(shipping._SHIPPED) == 1 and files

    def there(batches):
        from spanforge.operators import islands

        for b in batches:
            yield b.assign(id=len(islands.__doc__ or ""))

    assert spark.range(1).mapInPandas(there, "id long").first().id > 0
