"""Chat conversations from quoting messages.

Lines that begin with ``>`` (after blanks) are quoted, as deep as the number of those signs. Each run of lines of one
level is a passage; its text, lower-cased and without punctuation, is hashed. A passage of level 1 or more is linked to the first
message of its conversation whose own words hold the same text as a whole, a run or a line; a run that has no such original
as a whole is linked by its lines, to the latest original. A message replies to the latest original of its
least deep linked passage, or else to the message before it. A conversation lists each message after the one it replies to,
replies of one message in the order of turns, with all quoted lines, and the "... wrote:" line before them, left out.

Texts of fewer than ``least_words`` words link nothing; by default one word is enough. Defined cases: rows with a null conversation or turn are left out; a null role is
"unknown"; a null or blank text, or one of quotes only, has no entry of its own but is counted; repeated rows count once; several rows of one turn are
ordered by role and text; an empty table gives no rows; columns besides the named are ignored; whole texts are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.frames import cols

LEAST_WORDS = 1
WROTE = r"^\s*(?:On|Am|Le|El)\b.*\b(?:wrote|schrieb|écrit|escribió)\b.*:\s*$"


def normal(c) -> F.Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def reply_order(conv: np.ndarray, seq: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Each message's place in its conversation, parents first and depth first; rows ordered by (conv, seq)."""
    out = np.zeros(len(conv), np.int64)
    at = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
    for s, e in zip(at, np.r_[at[1:], len(conv)]):
        replies: dict[int, list[int]] = {}
        for k in range(s, e):
            replies.setdefault(int(parent[k]), []).append(k)
        stack, n = replies.get(0, [])[::-1], 0
        while stack:
            k = stack.pop()
            out[k] = n
            n += 1
            stack += replies.get(int(seq[k]), [])[::-1]
    return out


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not (got := [b for b in batches if b.num_rows]):
        return
    conv, seq, parent = (np.concatenate([np.asarray(b.column(c)) for b in got]) for c in ("conv", "seq", "parent"))
    o = np.lexsort((seq, conv))
    conv, seq, parent = conv[o], seq[o], parent[o]
    yield pa.RecordBatch.from_arrays([pa.array(conv), pa.array(seq), pa.array(reply_order(conv, seq, parent))], ["conv", "seq", "place"])


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(conv_id, n_messages, n_quotes, chat): the number of linked passages, and ``<|role|>`` blocks in reply order."""
    m = cols(messages, conv=conv_col, turn=turn_col, role=role_col, text=text_col).where("conv IS NOT NULL AND turn IS NOT NULL").distinct()
    m = m.select(F.col("conv").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    m = m.withColumn("seq", F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text")).cast("long"))

    lines = m.select("conv", "seq", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("pos", "line"))
    sign = F.regexp_extract("line", r"^(?:[ \t]*>)+", 0)
    lines = lines.withColumn("level", F.length(F.regexp_replace(sign, "[^>]", ""))).withColumn("said", F.expr(r"substring(line, length(regexp_extract(line, r'^(?:[ \t]*>)+', 0)) + 1)"))
    lines = lines.withColumn("key", normal("said"))
    here = Window.partitionBy("conv", "seq").orderBy("pos")
    blank = F.col("key") == ""
    fresh = (F.lag("level").over(here) != F.col("level")) | (F.lag(blank).over(here) != blank)
    lines = lines.withColumn("wrote", (F.col("level") == 0) & F.col("line").rlike(WROTE) & (F.coalesce(F.lead("level").over(here), F.lit(0)) > 0))
    lines = lines.withColumn("run", F.sum(F.when(F.coalesce(fresh, F.lit(True)), 1).otherwise(0)).over(here))

    by_pos = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c]), "\n" if c == "line" else " ")
    runs = lines.where(~F.col("wrote") & (F.col("key") != "")).groupBy("conv", "seq", "run", "level").agg(by_pos("key").alias("key"), F.collect_set("key").alias("each"))
    own_text = lines.where((F.col("level") == 0) & ~F.col("wrote")).groupBy("conv", "seq").agg(F.regexp_replace(by_pos("line"), r"^\s+|\s+$", "").alias("own"))

    telling = lambda c: (F.col(c) != "") & (F.size(F.split(c, " ")) >= least_words)
    first = runs.where("level = 0")
    originals = (
        first.select("conv", "seq", F.explode(F.array_append("each", F.col("key"))).alias("k"))
        .union(own_text.select("conv", "seq", normal("own").alias("k")))
        .where(telling("k"))
        .groupBy("conv", F.md5("k").alias("h"))
        .agg(F.min("seq").alias("orig"))
    )
    quoted = runs.where("level > 0")
    keys = quoted.select("conv", "seq", "run", "level", "key", F.explode(F.array_append("each", F.col("key"))).alias("k")).where(telling("k")).withColumn("h", F.md5("k"))
    hits = keys.join(originals, ["conv", "h"]).where("orig < seq")
    linked = hits.groupBy("conv", "seq", "run", "level").agg(F.coalesce(F.max(F.when(F.col("k") == F.col("key"), F.col("orig"))), F.max("orig")).alias("orig"))
    replied = linked.groupBy("conv", "seq").agg(F.max_by("orig", F.struct(-F.col("level"), "orig")).alias("parent"), F.count("*").alias("quotes"))

    told = m.select("conv", "seq", "role").join(replied, ["conv", "seq"], "left").join(own_text, ["conv", "seq"], "left")
    told = told.withColumn("parent", F.coalesce("parent", F.col("seq") - 1))
    places = told.select("conv", "seq", "parent").repartition("conv").mapInArrow(_ordered, "conv long, seq long, place long")
    block = F.struct("place", F.when(F.coalesce("own", F.lit("")) != "", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("own"))).alias("block"))
    chats = told.join(places, ["conv", "seq"]).groupBy("conv").agg(F.count("*").alias("n_messages"), F.coalesce(F.sum("quotes"), F.lit(0)).alias("n_quotes"), F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["block"]), "\n").alias("chat"))
    return chats.select(F.col("conv").alias("conv_id"), "n_messages", "n_quotes", "chat")


SQL = r"""
WITH RECURSIVE m AS (
    SELECT conv, role, text, row_number() OVER (PARTITION BY conv ORDER BY turn, role, text) AS seq
    FROM (SELECT DISTINCT conv_id AS conv, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
cut AS (SELECT conv, seq, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS ls FROM m),
l0 AS (SELECT conv, seq, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM cut),
l1 AS (SELECT *, regexp_extract(line, '^(?:[ \t]*>)+') AS sign FROM l0),
l2 AS (SELECT conv, seq, pos, line, length(regexp_replace(sign, '[^>]', '', 'g')) AS level,
       trim(regexp_replace(lower(substr(line, length(sign) + 1)), '[^\p{L}\p{N}]+', ' ', 'g')) AS key FROM l1),
l3 AS (SELECT *, level = 0 AND regexp_matches(line, '^\s*(?:On|Am|Le|El)\b.*\b(?:wrote|schrieb|écrit|escribió)\b.*:\s*$') AND coalesce(lead(level) OVER here, 0) > 0 AS wrote,
       CASE WHEN lag(level) OVER here = level AND (lag(key) OVER here = '') = (key = '') THEN 0 ELSE 1 END AS fresh
       FROM l2 WINDOW here AS (PARTITION BY conv, seq ORDER BY pos)),
l4 AS (SELECT *, sum(fresh) OVER (PARTITION BY conv, seq ORDER BY pos) AS run FROM l3),
runs AS (SELECT conv, seq, run, level, string_agg(key, ' ' ORDER BY pos) AS key, list(DISTINCT key) AS lines FROM l4 WHERE NOT wrote AND key <> '' GROUP BY ALL),
own AS (SELECT conv, seq, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\s+|\s+$', '', 'g') AS own FROM l4 WHERE level = 0 AND NOT wrote GROUP BY ALL),
held AS (SELECT conv, seq, unnest(list_append(lines, key)) AS k FROM runs WHERE level = 0
         UNION ALL SELECT conv, seq, trim(regexp_replace(lower(own), '[^\p{L}\p{N}]+', ' ', 'g')) FROM own),
originals AS (SELECT conv, k, min(seq) AS orig FROM held WHERE k <> '' GROUP BY ALL),
keys AS (SELECT conv, seq, run, level, key, unnest(list_append(lines, key)) AS k FROM runs WHERE level > 0),
linked AS (SELECT conv, seq, run, level, coalesce(max(orig) FILTER (WHERE k = key), max(orig)) AS orig
           FROM keys JOIN originals USING (conv, k) WHERE orig < seq GROUP BY ALL),
replied AS (SELECT conv, seq, (list(orig ORDER BY level, orig DESC))[1] AS parent, count(*) AS quotes FROM linked GROUP BY ALL),
told AS (SELECT conv, seq, role, own, quotes, coalesce(parent, seq - 1) AS parent FROM m LEFT JOIN replied USING (conv, seq) LEFT JOIN own USING (conv, seq)),
tree AS (SELECT conv, seq, [seq] AS path FROM told WHERE parent = 0
         UNION ALL SELECT t.conv, t.seq, list_append(p.path, t.seq) FROM told t JOIN tree p ON t.conv = p.conv AND t.parent = p.seq)
SELECT conv AS conv_id, count(*) AS n_messages, coalesce(sum(quotes), 0)::BIGINT AS n_quotes,
       coalesce(string_agg('<|' || role || '|>' || chr(10) || own, chr(10) ORDER BY path) FILTER (WHERE own <> ''), '') AS chat
FROM told JOIN tree USING (conv, seq) GROUP BY conv"""
