"""Operator 1: host-level quality rules.

Every text is measured once. Each rule has a `fails` flag; failures are added up by host, the rate of a host is
shrunk towards the rate of all hosts by a beta prior fitted to the hosts themselves (method of moments), and the
verdict of the host goes back to its documents: on a good host a document is rejected for a gross failure only, on a
bad host for any failure. A document without failures is kept on every host.

Defined results: a null or empty text has no words (and so fails `base`); texts of any length are measured whole; a null
host is a host of its own; a null or repeated id is kept as it is, one result row per input row, repeated rows included;
of equal lines or windows all but the first line, and all words of the windows, count; columns of docs may have any
names; an empty table gives no rows, and its hosts' prior is that of hosts all alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwake.llm import textbuf as tb
from gridwake.plans.materialize import join_checked, materialize

#: Characters that the symbol rule counts.
SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def measure(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """FEATURES of each text."""
    n = len(off) - 1
    inside = tb.SPACED[data]
    starts, ends = tb.spans(inside, off)
    owner = np.repeat(np.arange(n), tb.per_text(starts, off))
    words = tb.hash_spans(data, starts, ends)
    out = {"n_words": np.bincount(owner, minlength=n), "word_chars": tb.per_text(np.flatnonzero(inside & ((data & 0xC0) != 0x80)), off), "n_symbols": tb.per_text(np.flatnonzero(_SYMBOL[data]), off)}

    cut = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([off[:-1], cut + 1]), kind="stable")
    stop = np.sort(np.concatenate([off[1:], cut]), kind="stable")
    first = np.searchsorted(starts, begin)
    full = (first < len(starts)) & (stop > begin)
    full[full] = starts[first[full]] < stop[full]
    begin, stop = begin[full], stop[full]
    line_of = np.searchsorted(off, begin, "right") - 1
    _, once = np.unique(tb.keyed(tb.hash_spans(data, begin, stop), line_of), return_index=True)
    out["n_lines"] = np.bincount(line_of, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_of[once], minlength=n)

    covered = np.zeros(len(words), bool)
    if len(words) >= 3:
        whole = np.flatnonzero(owner[:-2] == owner[2:])
        _, which, times = np.unique(tb.keyed(tb.ngrams(words, 3)[whole], owner[whole]), return_inverse=True, return_counts=True)
        again = whole[times[which] > 1]
        for k in range(3):
            covered[again + k] = True
    out["n_repeat_words"] = np.bincount(owner[covered], minlength=n)
    return out


def _spare(docs: DataFrame, stem: str) -> str:
    """A prefix that no column of docs has."""
    while any(c.lower().startswith(stem) for c in docs.columns):
        stem += "_"
    return stem


def with_features(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """docs and its FEATURES as columns with a prefix that docs doesn't use; and that prefix."""
    stem = _spare(docs, "_rule_")
    text = f"{stem}text"
    wide = docs.withColumn(text, F.col(f"`{text_col}`").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches, text):
            got = measure(*tb.utf8(part[text]))
            rest = [k for k, c in enumerate(part.schema.names) if c != text]
            yield pa.RecordBatch.from_arrays([part.column(k) for k in rest] + [pa.array(got[c].astype(np.int64)) for c in FEATURES], names=[part.schema.names[k] for k in rest] + [stem + c for c in FEATURES])

    schema = T.StructType(docs.schema.fields + [T.StructField(stem + c, T.LongType()) for c in FEATURES])
    return wide.mapInArrow(run, schema), stem


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, *FEATURES), a row for each row of docs."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    wide, stem = with_features(narrow)
    return wide.select("id", "host", *(F.col(stem + c).alias(c) for c in FEATURES))


def rules(stem: str = "", min_words: int = 50, max_repeat_pct: int = 50, symbol_pct: int = 10, gross_symbol_pct: int = 50, dup_line_pct: int = 30) -> dict[str, Column]:
    """Named tests over FEATURES: `base` and `gross` reject by themselves, `failed` (any rule) only on a bad host."""
    n = {c: F.col(stem + c) for c in FEATURES}
    base = (n["n_words"] < min_words) | (100 * n["n_repeat_words"] > max_repeat_pct * n["n_words"])
    gross = 100 * n["n_symbols"] > gross_symbol_pct * n["n_words"]
    return {"base": base, "gross": gross, "failed": base | gross | (100 * n["n_symbols"] > symbol_pct * n["n_words"]) | (100 * n["n_dup_lines"] > dup_line_pct * n["n_lines"])}


def host_key(host: Column) -> Column:
    """Hosts as join keys: a null host is a key of its own."""
    return F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit("null"))


def host_rates(flagged: DataFrame, bad_rate: float = 0.6) -> DataFrame:
    """(host_key, n_docs, n_failed, rate, bad) from (host, failed).

    The prior comes from the hosts: with m and v the mean and variance of their rates, a + b = m (1 - m) / v - 1,
    held between 1 and 1000, and a = m (a + b); hosts alike give a strong prior, hosts unlike a weak one.
    """
    hosts = materialize(flagged.groupBy(host_key(F.col("host")).alias("host_key")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")), "hosts")
    own = F.col("n_failed") / F.col("n_docs")
    m, v = hosts.agg(F.avg(own), F.var_pop(own)).first()  # two numbers
    m, v = (0.5, 0.0) if m is None else (m, v)
    strength = min(1000.0, max(1.0, m * (1 - m) / v - 1)) if v > 0 else 1000.0
    rate = (F.col("n_failed") + m * strength) / (F.col("n_docs") + strength)
    return hosts.select("host_key", "n_docs", "n_failed", rate.alias("rate"), (rate > bad_rate).alias("bad"))


def _verdicts(flagged: DataFrame, rated: DataFrame, host: str, base: str, gross: str, failed: str, out: str) -> DataFrame:
    """flagged with the column `out`: whether the row is kept. Only bad hosts travel."""
    key, bad = f"{out}_key", f"{out}_bad"
    bad_hosts = rated.where("bad").select(F.col("host_key").alias(key), F.lit(True).alias(bad))
    joined = join_checked(flagged.withColumn(key, host_key(F.col(host))), bad_hosts, key)
    return joined.withColumn(out, ~F.col(base) & ~F.col(gross) & ~(F.col(failed) & F.coalesce(F.col(bad), F.lit(False)))).drop(key, bad)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", bad_rate: float = 0.6, **limits: int) -> DataFrame:
    """(id, host, *FEATURES, base, gross, failed, kept), a row for each row of docs."""
    measured = materialize(features(docs, id_col, text_col, host_col), "rule_features")
    flagged = measured.select("*", *(test.alias(name) for name, test in rules(**limits).items()))
    return _verdicts(flagged, host_rates(flagged, bad_rate), "host", "base", "gross", "failed", "kept")


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", bad_rate: float = 0.6, **limits: int) -> DataFrame:
    """The rows of docs that the rules and the verdicts of their hosts keep, with the columns of docs."""
    wide, stem = with_features(docs, text_col)
    flags = {name: f"{stem}is_{name}" for name in ("base", "gross", "failed")}
    flagged = wide.select("*", *(test.alias(flags[name]) for name, test in rules(stem, **limits).items()))
    rated = host_rates(flagged.select(F.col(f"`{host_col}`").alias("host"), F.col(flags["failed"]).alias("failed")), bad_rate)
    out = f"{stem}kept"
    return _verdicts(flagged, rated, host_col, flags["base"], flags["gross"], flags["failed"], out).where(out).select(docs.columns)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(c("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", c("base").alias("base_failed"), "kept")


QUERIES = {"op1_quality_rules": op1_quality_rules}

SQL = {
    "op1_quality_rules": r"""
WITH d AS (SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
tri AS (SELECT doc_id, pos, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
again AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM tri WHERE c IS NOT NULL) WHERE k > 1),
rep AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM again, range(0, 3) AS r(k) GROUP BY doc_id),
chars AS (SELECT doc_id, sum(length(word)) AS n FROM words GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, source, len(w) AS n_words, coalesce(chars.n, 0)::BIGINT AS word_chars, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols,
  coalesce(lines.dup, 0) AS n_dup_lines, coalesce(lines.n, 0) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN chars USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 100 * n_symbols > 50 * n_words AS gross,
  100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines AS soft FROM m),
h AS (SELECT source, count(*) AS n, sum(CASE WHEN base_failed OR gross OR soft THEN 1 ELSE 0 END) AS x FROM f GROUP BY source),
p AS (SELECT avg(x / n) AS m, var_pop(x / n) AS v FROM h),
k AS (SELECT m, CASE WHEN v > 0 THEN least(1000.0, greatest(1.0, m * (1 - m) / v - 1)) ELSE 1000.0 END AS s FROM p),
bad AS (SELECT source, (x + m * s) / (n + s) > 0.6 AS bad FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT gross AND NOT (bad AND soft) AS kept
FROM f JOIN bad ON f.source IS NOT DISTINCT FROM bad.source
"""
}
