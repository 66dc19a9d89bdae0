"""Inputs of the queries, as column arithmetic over the given tables, in the SQL that both engines read.

``@SERIES(n)@`` lists 0 .. n - 1 as column ``n`` of ``s``; ``@SECONDS(x)@`` is a timestamp in seconds.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_MEDIA = "conv_id * 10 + turn"
_Q = "chr(34)"

FIXTURES = {
    "image_meta": "SELECT p_partkey AS image_id, 1 + (p_partkey * 37) % 4000 AS height, 1 + (p_partkey * 91) % 4000 AS width FROM part",
    "video_meta": """SELECT o_orderkey AS video_id, 1 + o_orderkey % 1400 AS total_frames,
        CAST(CASE o_orderkey % 6 WHEN 0 THEN 23.976 WHEN 1 THEN 24 WHEN 2 THEN 25 WHEN 3 THEN 29.97 WHEN 4 THEN 30 ELSE 60 END AS DOUBLE) AS video_fps,
        120 + (o_orderkey * 7) % 1000 AS height, 160 + (o_orderkey * 13) % 1800 AS width, o_orderkey % 4 <> 0 AS has_audio,
        CAST(CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 97 = 0 THEN 1 + o_orderkey % 33 END AS DOUBLE) AS nframes,
        CASE WHEN o_orderkey % 5 = 1 OR o_orderkey % 97 = 0 THEN CAST(0.5 AS DOUBLE) + o_orderkey % 7 END AS fps,
        CAST(CASE WHEN o_orderkey % 5 = 2 THEN 2 + o_orderkey % 40 END AS DOUBLE) AS max_frames,
        CAST(CASE WHEN o_orderkey % 7 = 3 THEN 30000 END AS DOUBLE) AS max_pixels FROM orders""",
    "frame_pts": "SELECT video_id, s.n AS frame_no, s.n / video_fps AS pts FROM video_meta v @SERIES(total_frames)@",
    "audio_meta": """SELECT doc_id AS audio_id, n_chars AS mel_len, CASE WHEN doc_id % 29 = 0 THEN 2 ELSE 1 END AS channels FROM documents UNION ALL SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), 1 UNION ALL SELECT -2, 1, 1
        UNION ALL SELECT -3, 2, 1 UNION ALL SELECT -4, 199, 1 UNION ALL SELECT -5, 200, 1 UNION ALL SELECT -6, 201, 1""",
    "messages": f"""SELECT conv_id, turn, role, CASE WHEN role = 'system' THEN text ELSE
        '[{{"type":"text","text":"' || replace(replace(replace(text, chr(92), chr(92) || chr(92)), {_Q}, chr(92) || {_Q}), chr(10), chr(92) || 'n') || '"}}'
        || CASE WHEN turn % 3 = 0 THEN ',{{"type":"image"' || CASE
            WHEN conv_id % 17 = 0 THEN ''
            WHEN conv_id % 19 = 0 THEN ',"image":null'
            WHEN conv_id % 11 = 0 THEN ',"image_url":"' || uri || '"'
            WHEN conv_id % 13 = 0 THEN ',"image":"' || uri || '","image_url":"http://other/0.jpg"'
            ELSE ',"image":"' || uri || '"' END || CASE WHEN turn % 2 = 1 THEN ',"resized_height":280,"resized_width":420' WHEN conv_id % 3 = 1 THEN ',"min_pixels":200704,"max_pixels":401408' ELSE '' END || '}}' ELSE '' END
        || CASE WHEN conv_id % 4 = 1 AND turn % 2 = 1 THEN ',{{"type":"video","video":[' || CASE WHEN conv_id % 8 = 1 THEN '' ELSE '"/f/' || CAST(({_MEDIA}) % ni AS VARCHAR(20)) || '.jpg"' || CASE WHEN conv_id % 3 = 0 THEN ',"/f/' || CAST(({_MEDIA}) % ni AS VARCHAR(20)) || '.jpg"' ELSE '' END || CASE WHEN conv_id % 3 > 0 THEN ',"/f/' || CAST(({_MEDIA} + conv_id % 3 - 1) % ni AS VARCHAR(20)) || '.jpg"' ELSE '' END || ',"/f/' || CAST(({_MEDIA}) % ni AS VARCHAR(20)) || '.jpg"' END || ']' || CASE WHEN conv_id % 5 = 1 THEN ',"max_pixels":50176' WHEN conv_id % 5 = 2 THEN ',"resized_height":140,"resized_width":252' ELSE '' END || '}}' ELSE '' END
        || CASE WHEN conv_id % 5 = 0 AND turn % 2 = 0 THEN ',{{"type":"video","video":"file:///v/' || CAST(({_MEDIA}) % nv AS VARCHAR(20)) || '.mp4"' || CASE WHEN conv_id % 10 = 0 THEN ',"fps":1.0' ELSE '' END || '}}' ELSE '' END
        || CASE WHEN conv_id % 7 = 0 THEN ',{{"type":"audio","audio":"' || CASE WHEN turn % 2 = 0 THEN 'https://a/' ELSE '/a/' END || CAST(({_MEDIA}) % na AS VARCHAR(20)) || '.wav"}}' ELSE '' END
        || ']' END AS content
        FROM (SELECT c.*, ni, nv, na, CASE (conv_id + turn) % 6 WHEN 0 THEN 'http://i/' || CAST(({_MEDIA}) % ni AS VARCHAR(20)) || '.jpg' WHEN 1 THEN 'https://i/' || CAST(({_MEDIA}) % ni AS VARCHAR(20)) || '.jpg'
            WHEN 2 THEN 'file:///i/' || CAST(({_MEDIA}) % ni AS VARCHAR(20)) || '.jpg' WHEN 3 THEN 'data:image/png;base64,aW1nYmFz' WHEN 4 THEN '/i/' || CAST(({_MEDIA}) % ni AS VARCHAR(20)) || '.jpg' ELSE 'data:image/png,raw' END AS uri
            FROM conversations c CROSS JOIN (SELECT count(*) AS ni FROM part) i CROSS JOIN (SELECT count(*) AS nv FROM orders) v CROSS JOIN (SELECT count(*) AS na FROM documents) a) x""",
    "remote": "SELECT 'http://i/' || CAST(p_partkey AS VARCHAR(20)) || '.jpg' AS url, p_name AS payload FROM part WHERE p_partkey % 3 <> 0",
    "frame_lists": "SELECT p_partkey AS video_id, s.n AS frame_no, CASE WHEN p_partkey % 3 = 0 THEN p_partkey ELSE (p_partkey + s.n) % np END AS image_id FROM (SELECT p_partkey, np FROM part CROSS JOIN (SELECT count(*) AS np FROM part) c) v @SERIES(1 + p_partkey % 5)@",
    "segments": """SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY turn, k) - 1 AS seg_no, kind, CAST(len AS BIGINT) AS len, CAST(t AS BIGINT) AS grid_t, CAST(h AS BIGINT) AS grid_h, CAST(w AS BIGINT) AS grid_w, CAST(sec AS DOUBLE) AS sec FROM (
        SELECT conv_id AS sample_id, turn, 0 AS k, 'text' AS kind, 1 + length(text) % 50 AS len, 0 AS t, 0 AS h, 0 AS w, 0 AS sec FROM conversations
        UNION ALL SELECT conv_id, turn, 1, 'bos', 1, 0, 0, 0, 0 FROM conversations WHERE turn % 3 = 0
        UNION ALL SELECT conv_id, turn, 2, 'image', (2 + conv_id % 5) * (3 + turn % 4), 1, 4 + 2 * (conv_id % 5), 6 + 2 * (turn % 4), 1 FROM conversations WHERE turn % 3 = 0
        UNION ALL SELECT conv_id, turn, 3, 'eos', 1, 0, 0, 0, 0 FROM conversations WHERE turn % 3 = 0
        UNION ALL SELECT conv_id, turn, 4, 'bos', 1, 0, 0, 0, 0 FROM conversations WHERE conv_id % 5 = 0 AND turn % 2 = 0
        UNION ALL SELECT conv_id, turn, 5, 'video', (2 + conv_id % 6) * 6, 2 + conv_id % 6, 4, 6, CAST(0.37 AS DOUBLE) * (1 + conv_id % 3) FROM conversations WHERE conv_id % 5 = 0 AND turn % 2 = 0
        UNION ALL SELECT conv_id, turn, 6, 'eos', 1, 0, 0, 0, 0 FROM conversations WHERE conv_id % 5 = 0 AND turn % 2 = 0
        UNION ALL SELECT conv_id, turn, 7, 'bos', 1, 0, 0, 0, 0 FROM conversations WHERE conv_id % 7 = 0
        UNION ALL SELECT conv_id, turn, 8, 'audio', 1 + (conv_id * 131 + turn * 17) % 100, 0, 0, 0, 0 FROM conversations WHERE conv_id % 7 = 0
        UNION ALL SELECT conv_id, turn, 9, 'eos', 1, 0, 0, 0, 0 FROM conversations WHERE conv_id % 7 = 0) x""",
    "tokens": """SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY seg_no, s.n) - 1 AS pos, kind, seg_no,
        CASE kind WHEN 'pad' THEN 0 WHEN 'bos' THEN 90001 WHEN 'eos' THEN 90002 WHEN 'image' THEN 90003 WHEN 'video' THEN 90004 WHEN 'audio' THEN 90005 ELSE 1 + (sample_id * 7 + seg_no * 31 + s.n) % 50000 END AS token_id,
        CASE WHEN kind = 'pad' THEN 0 ELSE 1 END AS mask FROM (
        SELECT sample_id, seg_no, kind, len FROM segments
        UNION ALL SELECT sample_id, CAST(-1 AS BIGINT), 'pad', sample_id % 4 FROM (SELECT DISTINCT sample_id FROM segments) a
        UNION ALL SELECT sample_id, CAST(1000000 AS BIGINT), 'pad', CAST(1 AS BIGINT) FROM (SELECT DISTINCT sample_id FROM segments WHERE sample_id % 10 = 0) b) v @SERIES(len)@""",
    "ids": "SELECT sample_id, pos, CASE WHEN token_id = 90001 AND lead(token_id) OVER (PARTITION BY sample_id ORDER BY pos) = 90005 THEN 90006 ELSE token_id END AS token_id, mask FROM tokens",
    "id_grids": "SELECT sample_id, kind AS modality, row_number() OVER (PARTITION BY sample_id, kind ORDER BY seg_no) - 1 AS k, grid_t, grid_h, grid_w, sec FROM segments WHERE kind IN ('image', 'video')",
    "id_audios": "SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY seg_no) - 1 AS k, 4 * len + CASE WHEN sample_id % 23 = 0 THEN 8 ELSE 0 END AS mel_len FROM segments WHERE kind = 'audio'",
    "av_segments": """SELECT sample_id, seg_no, 0 AS part, CASE WHEN kind = 'bos' AND nk = 'audio' THEN 'heard' ELSE kind END AS kind, CASE WHEN kind = 'eos' AND pk = 'video' THEN 2 ELSE len END AS len FROM (SELECT *, lead(kind) OVER (PARTITION BY sample_id ORDER BY seg_no) AS nk, lag(kind) OVER (PARTITION BY sample_id ORDER BY seg_no) AS pk FROM segments) x
        UNION ALL SELECT sample_id, seg_no, 1, 'audio', 1 + (sample_id * 37 + seg_no * 11) % 120 FROM segments WHERE kind = 'video'
        UNION ALL SELECT sample_id, seg_no - 1, 1, 'heard', 1 FROM segments WHERE kind = 'video'""",
    "av_ids": """SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY seg_no, part, s.n) - 1 AS pos,
        CASE kind WHEN 'pad' THEN 0 WHEN 'bos' THEN 90001 WHEN 'heard' THEN 90006 WHEN 'eos' THEN 90002 WHEN 'image' THEN 90003 WHEN 'video' THEN 90004 WHEN 'audio' THEN 90005 ELSE 1 + (sample_id * 7 + seg_no * 31 + s.n) % 50000 END AS token_id,
        CASE WHEN kind = 'pad' THEN 0 ELSE 1 END AS mask FROM (
        SELECT sample_id, seg_no, part, kind, len FROM av_segments
        UNION ALL SELECT sample_id, CAST(-9 AS BIGINT), 0, 'pad', sample_id % 4 FROM (SELECT DISTINCT sample_id FROM segments) a
        UNION ALL SELECT sample_id, CAST(1000000 AS BIGINT), 0, 'pad', CAST(1 AS BIGINT) FROM (SELECT DISTINCT sample_id FROM segments WHERE sample_id % 10 = 0) b) v @SERIES(len)@""",
    "av_audios": "SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY seg_no, part) - 1 AS k, 4 * len AS mel_len FROM av_segments WHERE kind = 'audio'",
    "features": "SELECT CAST(label AS BIGINT) AS item, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, vec_id, embedding AS vec FROM embeddings",
    "timed": """SELECT item, i, CAST(sum(step) OVER (PARTITION BY item ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS t FROM (
        SELECT user_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
        CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 THEN 0 ELSE CAST(floor(value) AS BIGINT) % 60 END AS step FROM events) x""",
    "speakers": "SELECT n_name AS name, CAST(1000 + n_nationkey AS BIGINT) AS bos_token FROM nation",
    "requests": "SELECT c_custkey AS req_id, CASE WHEN c_custkey % 50 = 0 THEN 'nobody' ELSE 'NATION_' || CAST(c_nationkey AS VARCHAR(10)) END AS speaker, c_custkey % 2 = 0 AS speech, 1 + c_custkey % 3 AS batch FROM customer",
    "codes": "SELECT l_orderkey AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS pos, l_partkey % 8192 AS code FROM lineitem",
    "series": "SELECT user_id AS item, @SECONDS(ts)@ AS ts, event_id, value FROM events",
    "rollouts": "SELECT user_id AS prompt, event_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 8 AS BIGINT) AS g, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 8.0) AS BIGINT) AS grp, value AS k, value / 10 AS k_ratio, CAST(event_id % 7 AS DOUBLE) AS a, CAST(event_id % 3 AS DOUBLE) AS g_score FROM events",
    "steps": "SELECT user_id AS conv, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS batch, 1 + CAST(floor(value) AS BIGINT) % 20 AS len, event_id FROM events",
}

_DUCKDB = {r"@SERIES\((.*?)\)@": r"CROSS JOIN LATERAL unnest(range(0, CAST(\1 AS BIGINT))) AS s(n)", r"@SECONDS\((.*?)\)@": r"(epoch_us(\1) / 1e6)"}
_SPARK = {r"@SERIES\((.*?)\)@": r"LATERAL VIEW explode(CASE WHEN (\1) > 0 THEN sequence(0L, CAST(\1 AS BIGINT) - 1) ELSE CAST(array() AS ARRAY<BIGINT>) END) s AS n", r"@SECONDS\((.*?)\)@": r"(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(\1 AS TIMESTAMP_NTZ)) / 1e6D)"}


def _in(dialect: dict[str, str], sql: str) -> str:
    for find, put in dialect.items():
        sql = re.sub(find, put, sql)
    return sql


def _needs(sql: str, known) -> list[str]:
    return [n for n in known if re.search(rf"\b{n}\b", sql)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture, or a given table, as a DataFrame."""
    if name not in FIXTURES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _in(_SPARK, FIXTURES[name])
    inputs = {m for m in re.findall(r"(?:FROM|JOIN) (\w+)\b", sql) if m != "SELECT"}
    frames = {m: table(spark, sf_dir, m) for m in inputs}
    sql = re.sub(r"\b(FROM|JOIN) (\w+)\b", r"\1 {\2}", sql.replace("{", "{{").replace("}", "}}"))
    return spark.sql(sql, **frames)


def duckdb_sql(body: str) -> str:
    """``body`` (a SELECT, possibly with its own CTEs after ``WITH``) after the fixtures that it names."""
    wanted: list[str] = []

    def add(sql: str, own: str = "") -> None:
        for n in _needs(sql, FIXTURES):
            if n != own and n not in wanted:
                add(FIXTURES[n], n)
                if n not in wanted:
                    wanted.append(n)

    add(body)
    ctes = ",\n".join(f"{n} AS ({_in(_DUCKDB, FIXTURES[n])})" for n in wanted)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[14:].strip()}" if ctes else body
    if body.upper().startswith("WITH"):
        return f"WITH {ctes},\n{body[4:].strip()}" if ctes else body
    return f"WITH {ctes}\n{body}" if ctes else body
