"""DuckDB SQL for the queries of live sessions: ticks folded by a recursive query."""

from __future__ import annotations

_TICKS = """m AS (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 60000000 AS m FROM events),
    c AS (SELECT user_id, m // 120 + 1 AS tick, m, event_id, struct_pack(st := m / 60.0::DOUBLE, en := (m + CAST(floor(value) AS BIGINT)) / 60.0::DOUBLE,
        src := CASE event_type WHEN 'view' THEN 'asr' WHEN 'click' THEN 'ocr' WHEN 'purchase' THEN 'ocr_persist_tr' WHEN 'signup' THEN 'ocr+intent' ELSE 'ocr' END,
        sig := event_type || ' x' || regexp_extract(props, '([0-9]+)', 1), trg := [event_type], txt := [event_type || ' x' || regexp_extract(props, '([0-9]+)', 1)], n := 1, score := CAST(floor(value) AS BIGINT) % 4) AS c FROM m),
    l AS (SELECT user_id, max(tick) AS last FROM c GROUP BY 1),
    s AS (SELECT user_id, tick, list(c ORDER BY m, event_id) AS cs FROM c GROUP BY 1, 2),
    t AS MATERIALIZED (SELECT l.user_id, k.tick, k.tick * 2.0::DOUBLE AS now, k.tick = l.last AS done, coalesce(s.cs, []) AS cs FROM l, LATERAL (SELECT unnest(range(1, l.last + 1)) AS tick) k LEFT JOIN s ON s.user_id = l.user_id AND s.tick = k.tick)"""
_T = "STRUCT(track BIGINT, st DOUBLE, en DOUBLE, src VARCHAR, sig VARCHAR, trg VARCHAR[], txt VARCHAR[], n BIGINT, score BIGINT)"
_C = "STRUCT(st DOUBLE, en DOUBLE, src VARCHAR, sig VARCHAR, trg VARCHAR[], txt VARCHAR[], n BIGINT, score BIGINT)"
_E = f"STRUCT(tracks {_T}[], number BIGINT, c {_C})"


def _plus(signal: str, inner: str) -> str:
    return f"({inner} || CASE WHEN contains(x.c.src, '{signal}') AND NOT contains({inner}, '{signal}') THEN '+{signal}' ELSE '' END)"


_MEETS = """(len(o.sig) > 0 AND len(x.c.sig) > 0 AND (contains(o.sig, x.c.sig) OR contains(x.c.sig, o.sig)))
    OR (x.c.st <= o.en + 6 AND x.c.en >= o.st - 6 AND NOT contains(o.src, 'persist') AND NOT contains(x.c.src, 'persist'))"""
_SRC = "o.src"
for _signal in ("ocr", "asr", "intent"):
    _SRC = _plus(_signal, _SRC)
_EXTENDED = f"""struct_pack(track := o.track, st := least(o.st, x.c.st), en := greatest(o.en, x.c.en), src := {_SRC}, sig := CASE WHEN o.sig = '' THEN x.c.sig ELSE o.sig END,
    trg := CASE WHEN list_contains(o.trg, x.c.trg[1]) THEN o.trg ELSE list_concat(o.trg, x.c.trg) END, txt := list_concat(o.txt, x.c.txt), n := o.n + x.c.n, score := greatest(o.score, x.c.score))"""
_FOUND = f"coalesce(list_position(list_transform(a.tracks, lambda o: {_MEETS}), true), 0)"
_STEP = f"""CAST(struct_pack(tracks := CASE WHEN {_FOUND} = 0
        THEN list_append(a.tracks, CAST(struct_pack(track := a.number, st := x.c.st, en := x.c.en, src := x.c.src, sig := x.c.sig, trg := x.c.trg, txt := x.c.txt, n := x.c.n, score := x.c.score) AS {_T}))
        ELSE list_transform(list_zip(a.tracks, range(1, len(a.tracks) + 1), list_transform(a.tracks, lambda o: {_FOUND})), lambda z: CASE WHEN z[2] = z[3] THEN list_transform([z[1]], lambda o: {_EXTENDED})[1] ELSE z[1] END) END,
    number := a.number + CASE WHEN {_FOUND} = 0 THEN 1 ELSE 0 END, c := NULL) AS {_E})"""
#: Ticks in turn: evidence is folded into the tracks, then they are parted into closed and open ones.
_RUN = f"""run AS (SELECT user_id, CAST(0 AS BIGINT) AS tick, CAST(0 AS DOUBLE) AS now, false AS done, CAST([] AS {_T}[]) AS tracks, CAST(0 AS BIGINT) AS number, CAST([] AS {_T}[]) AS closed FROM l
    UNION ALL SELECT user_id, tick, now, done, list_filter(a.tracks, lambda o: NOT (done OR now - o.en >= 6 OR o.en - o.st >= 180)), a.number, list_filter(a.tracks, lambda o: (done OR now - o.en >= 6 OR o.en - o.st >= 180) AND o.en - o.st >= 2 AND o.score >= 1)
    FROM (SELECT t.user_id, t.tick, t.now, t.done, list_reduce(list_transform(t.cs, lambda c: CAST(struct_pack(tracks := NULL, number := 0, c := struct_pack(st := c.st, en := least(c.en, t.now), src := c.src, sig := c.sig, trg := c.trg, txt := c.txt, n := c.n, score := c.score)) AS {_E})),
        lambda a, x: {_STEP}, CAST(struct_pack(tracks := r.tracks, number := r.number, c := NULL) AS {_E})) AS a FROM run r JOIN t ON t.user_id = r.user_id AND t.tick = r.tick + 1) f)"""
_LOG = """e AS (SELECT user_id, tick, 0 AS part, unnest(range(1, len(closed) + 1)) AS i, unnest(closed) AS o FROM run UNION ALL SELECT user_id, tick, 1, unnest(range(1, len(tracks) + 1)), unnest(tracks) FROM run),
    g AS (SELECT *, row_number() OVER (PARTITION BY user_id, tick ORDER BY o.track) AS k FROM e WHERE part = 0 OR o.score >= 1 UNION ALL SELECT user_id, tick, 2, 0, NULL, 1000000 FROM run WHERE done),
    q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tick, k) AS seq FROM g)"""

ORACLES: dict[str, str] = {
    "live_tracks": f"WITH RECURSIVE {_TICKS}, {_RUN} SELECT user_id, o.track AS track, tick * 2 AS now_h, round(o.st, 4) AS start_h, round(o.en, 4) AS end_h, o.src AS source, o.sig AS signature, array_to_string(o.trg, ',') AS triggers, md5(array_to_string(o.txt, '|')) AS texts_md5, o.n AS n_frames, o.score AS score FROM (SELECT user_id, tick, unnest(closed) AS o FROM run)",
    "live_log": f"""WITH RECURSIVE {_TICKS}, {_RUN}, {_LOG}
        SELECT user_id, seq, tick * 2 AS now_h, CASE part WHEN 0 THEN 'emitted' WHEN 1 THEN 'open' ELSE 'session_end' END AS event, CASE part WHEN 0 THEN 'COMMITTED' WHEN 2 THEN 'ENDED' ELSE CASE WHEN o.en - o.st >= 2 THEN 'EXTENDING' ELSE 'PROVISIONAL' END END AS status,
            coalesce(o.track, -1) AS track, round(coalesce(o.en, tick * 2), 4) AS end_h FROM q QUALIFY seq > max(seq) OVER (PARTITION BY user_id) - 50""",
    "judgment_cache": """WITH m AS (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 60000000 AS m, CASE WHEN user_id % 2 = 0 THEN 'vod' ELSE 'short' END AS kind,
            CASE event_type WHEN 'view' THEN 'asr' WHEN 'click' THEN 'ocr' WHEN 'purchase' THEN 'ocr_persist_tr' WHEN 'signup' THEN 'ocr+intent' ELSE 'ocr' END AS src, event_type || ' ' || event_id AS t FROM events),
        c AS (SELECT user_id, event_id, substr(sha256(kind || '|' || src || '|' || m || '.00|' || (m + 9) || '.00|' || t || '|'), 1, 24) AS cache_key,
            CASE WHEN value >= 20 THEN 'new ' || t WHEN user_id % 3 > 0 OR value >= 5 THEN 'old ' || t END AS j, contains(src, 'asr') OR contains(src, 'intent') OR (kind = 'vod' AND m > 15) AS worth FROM m),
        o AS (SELECT *, CASE WHEN NOT bool_or(worth) OVER (PARTITION BY user_id) THEN 'skipped' WHEN bool_and(j IS NOT NULL) OVER (PARTITION BY user_id) THEN 'cache' ELSE 'ask' END AS outcome FROM c)
        SELECT user_id, event_id, cache_key, outcome, CASE WHEN outcome = 'cache' THEN j END AS judgment FROM o""",
    "similar_bags": """WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda w: length(w) > 3) AS ws FROM conversations), v AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda w: length(w) > 3) AS ws FROM benchmark),
        a AS (SELECT conv_id, turn, t, count(*) AS n FROM (SELECT conv_id, turn, unnest(ws) AS t FROM w) GROUP BY 1, 2, 3), b AS (SELECT item_id, t, count(*) AS n FROM (SELECT item_id, unnest(ws) AS t FROM v) GROUP BY 1, 2),
        la AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS l FROM a GROUP BY 1, 2), lb AS (SELECT item_id, sqrt(sum(n * n)) AS l FROM b GROUP BY 1), d AS (SELECT conv_id, turn, item_id, sum(a.n * b.n) AS dot FROM a JOIN b USING (t) GROUP BY 1, 2, 3)
        SELECT conv_id, turn, item_id, round(dot / (la.l * lb.l), 6) AS cosine FROM d JOIN la USING (conv_id, turn) JOIN lb USING (item_id) WHERE dot / (la.l * lb.l) >= 0.15""",
}
