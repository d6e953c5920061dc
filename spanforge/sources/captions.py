"""Caption files and transcript selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.text import clock_seconds, strip_markup
from spanforge.operators.folds import rolling_dedupe

_TIMES = r"([0-9:]+[.,][0-9]+)[\x20\x09]+-->[\x20\x09]+([0-9:]+[.,][0-9]+)"


def language_of(path: Column) -> Column:
    """The language in a file name such as talk.te-orig.vtt; empty if there is none."""
    return F.regexp_extract(path, r"\.([A-Za-z]{2,3}(?:-[A-Za-z]+)?)\.vtt$", 1)


def language_rank(lang: Column) -> Column:
    """Original tracks first, and of them those that aren't English; then English, then others."""
    original = F.endswith(lang, F.lit("-orig"))
    return F.when(original & ~F.startswith(lang, F.lit("en")), 0).when(original, 1).when(F.startswith(lang, F.lit("en")), 2).otherwise(3)


def cues(files: DataFrame, key: str, body: str) -> DataFrame:
    """Caption lines of VTT texts: key, seq, start_s, end_s, text."""
    blocks = files.select(key, F.posexplode(F.split(F.regexp_replace(body, "\r\n?", "\n"), "\n[\x20\x09]*\n+")).alias("seq", "block"))
    line = F.transform(F.split("block", "\n"), lambda x: F.trim(x))
    spoken = F.filter(line, lambda x: (x != "") & ~x.rlike(_TIMES) & ~x.rlike("^[0-9]+$") & ~x.rlike("^(WEBVTT|NOTE|STYLE|REGION|Kind:|Language:)"))
    timed = blocks.where(F.col("block").rlike(_TIMES) & ~F.col("block").rlike(r"^[\x20\x09\n]*NOTE"))
    out = timed.select(
        key,
        "seq",
        clock_seconds(F.regexp_extract("block", _TIMES, 1)).alias("start_s"),
        clock_seconds(F.regexp_extract("block", _TIMES, 2)).alias("end_s"),
        strip_markup(F.array_join(spoken, " ")).alias("text"),
    )
    return out.where("text <> '' AND start_s IS NOT NULL")


def read_vtt(spark: SparkSession, path: str) -> DataFrame:
    """Caption lines of the files under a path, with file and language; each file is one text."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return cues(files, "file", "value").withColumn("lang", language_of(F.col("file")))


def best_track(lines: DataFrame, key: str, lang: str = "lang") -> DataFrame:
    """Lines of each key's best-ranked track only."""
    best = lines.groupBy(key).agg(F.min_by(lang, F.struct(language_rank(F.col(lang)), F.col(lang))).alias(lang))
    return lines.join(best, [key, lang], "left_semi")


def choose_transcript(captions: DataFrame, spoken: DataFrame, key: str, *, having: DataFrame | None = None) -> DataFrame:
    """Supplied captions where a key has any, else recognised speech; marked by source. ``having`` has the keys with captions where they come cheaper than the captions."""
    rest = spoken.join((captions if having is None else having).select(key).distinct(), key, "left_anti")
    return captions.withColumn("source", F.lit("captions")).unionByName(rest.withColumn("source", F.lit("speech")), allowMissingColumns=True)


def transcript(captions: DataFrame, spoken: DataFrame, key: str, *, order: str = "seq", start: str = "start_s", end: str = "end_s", text: str = "text", within: float = 3.0) -> DataFrame:
    """As choose_transcript, rolling captions folded; recognised speech doesn't roll and stays as it is."""
    columns = (key, order, start, end, text)
    folded = rolling_dedupe(captions.select(*columns), [key], order=order, start=start, end=end, text=text, within=within)
    # A fold keeps a line of each key that has any, so its keys are known without a second fold.
    return choose_transcript(folded, spoken.select(*columns), key, having=captions.where(F.trim(F.col(text)) != ""))
