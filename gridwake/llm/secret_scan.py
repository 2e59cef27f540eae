"""Operator 2: secrets by known forms and by dictionary-primed novelty.

Three known forms are found by their patterns. Beyond them, a string of 8 or more characters in a sensitive context is a
candidate: one behind a name, of any length, with a word such as "key" or "credential" in it, and an operator (=, :, ->, is, was, ...)
that stands at most REACH characters behind the name in the same sentence, the value on the same line or the next; or one right behind the name.
A value goes up to its closing quote or, without quotes, to a blank, bracket, comma or semicolon. A candidate is compressed with
zstandard, primed with a dictionary of identifiers and of the text around it; what it costs on top of an empty input are its
marginal bytes. Names, paths and repeated strings cost little; a string that costs nearly its own entropy is new to its
surroundings and reported, or what known forms leave of it. The values of known forms are measured as well.

The identifiers are a fixed list and not learned from the corpus: strings that copies of one text repeat would get into
a learned one, and secrets are among them.

Defined results: a null or empty text has no findings; texts of any length are read whole, one at a time; ids may be null
or repeated and keep their type; a row for each row of docs, repeated ones included; other columns are not read, whatever
their names, or pass through (without_secrets); an empty table gives no rows. Spans are code points, the end exclusive;
spans that begin together stand in the order of KINDS.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwake.llm import textbuf as tb

#: Fixed forms: name, pattern, the group whose length counts, and the least length. The order ranks equal starts.
KINDS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),
)
NOVEL = "novel"
_NAMES = (*(k[0] for k in KINDS), NOVEL)
#: Characters between a name and its operator at most.
REACH = 96
#: Names that hold a sensitive word: key, pass and pwd count at the start of a part of a name (API_KEY, encryptionKey) and, right
#: before an operator, anywhere (sshkey=). Patterns are tried where one of the stems stands.
_STEMS = "credential pass private auth bearer access signing session cookie secret token api key pwd".split()
_WORD = re.compile(r"(?:credential|passphrase|passwd|password|private|auth|bearer|access|signing|session|cookie|secret|token|api_?key)|(?:(?<![a-z])|(?-i:(?<=[a-z])(?=[A-Z])))(?:key|pass|pwd)", re.IGNORECASE | re.ASCII)
_SHORT_WORD = re.compile("key|pass|pwd", re.IGNORECASE | re.ASCII)
_REST_OF_NAME = re.compile(r"[A-Za-z0-9_-]*+")
_OPERATOR = r"(?:=>|:=|->|==|[:=]|\b(?:is|was)\b)"
_BEFORE = r"""[ \t]*(?:\r?\n[ \t]*)?(?:(?:basic|bearer|digest|token)\x20+)?"""
_VALUE = r"""(?:"([^"\s]{8,})"|'([^'\s]{8,})'|`([^`\s]{8,})`|["'`(\[{<]{0,2}(?:(?:basic|bearer|digest|token)\x20+)?([A-Za-z0-9+/_.=!@#$%^&*~?|:-]{8,}))"""
_ASSIGNED = re.compile(_OPERATOR + _BEFORE + _VALUE, re.IGNORECASE | re.ASCII)
_AT_ONCE = re.compile(r"""["'`\])}>]{0,2}[ \t]*""" + _OPERATOR + _BEFORE + _VALUE, re.IGNORECASE | re.ASCII)
_NEXT = re.compile(r"""(?:["'`\])}>]{1,2}|[ \t])""" + _BEFORE + _VALUE, re.IGNORECASE | re.ASCII)
#: Longer strings that follow a word without a break.
_UNBROKEN = re.compile(r"(?:credential|passphrase|private|auth|bearer|access|signing|session|cookie|\bkey|\bpwd|\bpass)[A-Za-z_]{0,16}([A-Za-z0-9+/_.=-]{20,})", re.IGNORECASE | re.ASCII)
_SENTENCE = re.compile(r"[.!?;](?=\s)|\n[ \t]*\n")
#: Identifiers that code is made of; the dictionary of the novelty test begins with them.
IDENTIFIERS = (
    "abstract access account action address admin algorithm allow api app application args array assert async auth author "
    "authorization await base64 body boolean bucket buffer build bytes cache callback case catch certificate charset check "
    "class client cloud cluster code color column command comment commit component config connection console const "
    "constructor container content context controller cookie copy count create credential credentials current data database "
    "date debug decode default define delete description device digest directory disabled document domain download element "
    "email enabled encode encoding encrypt endpoint entry environment error event example exception execute expires export "
    "factory false field file filter final find format frame from function generate get global group handler hash header "
    "height hidden host html http https identifier image import include index info init input instance integer interface "
    "internal item iterator json key label language last length level library limit line link list listener load local "
    "location login logger logout main manager map master match message metadata method model module mount name namespace "
    "native network node null number object offset option order output owner package page parameter parent parse password "
    "path pattern payload permission pipeline placeholder plugin policy port position prefix primary print private process "
    "production profile project property protected protocol provider proxy public publish query queue random range read "
    "record redirect reference register release remote remove render replace repository request require reset resource "
    "response result return role root route schema scope script search secret section secure select sequence server service "
    "session setting signature signing size socket source standard start state static status storage store stream string "
    "struct submit success super switch system table target task template test text thread time timeout timestamp title "
    "token trace transaction true type undefined unique update upload user username util validate value variable vendor "
    "version view void volume width window worker write"
).replace(" ", "_").encode()


_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _letter_bits(names: str) -> dict[str, float]:
    """Bits of each letter behind another one, and of each first letter of a part of a name, in names; unseen ones cost most."""
    pairs = Counter(a + b for w in _PART.findall(names) for a, b in zip(" " + w.lower(), w.lower()))
    firsts = Counter(p[0] for p in pairs.elements())
    letters = "abcdefghijklmnopqrstuvwxyz"
    return {a + b: -math.log2((pairs[a + b] + 0.3) / (firsts[a] + 0.3 * 26)) for a in " " + letters for b in letters}


_BITS = _letter_bits(IDENTIFIERS.decode())


class Novelty:
    """Marginal bytes of strings over a dictionary."""

    def __init__(self, around: int = 256, rate: float = 0.62):
        self.around, self.rate = around, rate

    def cost(self, candidate: str, context: str) -> int:
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS + context.encode("utf-8", "surrogatepass"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        pack = zstandard.ZstdCompressor(level=3, dict_data=primed, write_checksum=False, write_content_size=False).compress
        return len(pack(candidate.encode())) - len(pack(b""))

    def letter_cost(self, own: str) -> float:
        """Bytes of a string without digits, by the letters of identifiers; a break between its parts costs two bits."""
        parts = _PART.findall(own)
        return (sum(_BITS[a + b] for w in parts for a, b in zip(" " + w.lower(), w.lower())) + 2 * (len(parts) - 1)) / 8

    def is_new(self, text: str, start: int, end: int) -> bool:
        """Whether text[start:end] costs nearly its length. Words no dictionary holds are told from letters at random by their letters."""
        own = text[start:end]
        if not any(c.isdigit() for c in own) and self.letter_cost(own) < self.rate * len(own):
            return False
        near = text[max(0, start - self.around) : start] + text[end : end + self.around]
        return self.cost(own, near) >= self.rate * len(own)


def known_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed forms."""
    out = []
    for k, (_, pattern, group, least) in enumerate(KINDS):
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


def _value(m: re.Match) -> tuple[int, int]:
    """Where a match's value stands; one without quotes ends without a sentence's stop."""
    k = m.lastindex
    start, end = m.span(k)
    return (start, start + len(m[k].rstrip(".?:"))) if k == m.re.groups else (start, end)


def candidates(text: str) -> list[tuple[int, int]]:
    """Distinct (start, end) of the strings in a sensitive context. A name is looked at once, however many words it holds."""
    low = text.replace("İ", "i").lower()  # the one letter that grows
    found, names = set(), {}
    for stem in _STEMS:
        at, end = low.find(stem), -1
        while at >= 0:
            if m := _UNBROKEN.match(text, at):
                found.add((m.start(1), m.start(1) + len(m[1].rstrip("."))))
            strong = _WORD.match(text, at) is not None
            if strong or _SHORT_WORD.match(text, at):
                if at >= end:
                    end = _REST_OF_NAME.match(text, at).end()
                names[end] = names.get(end, False) or strong
            at = low.find(stem, at + 1)
    for end, strong in names.items():
        found.update(map(_value, filter(None, (p.match(text, end) for p in ((_AT_ONCE, _NEXT) if strong else (_AT_ONCE,))))))
        if strong:
            stop = _SENTENCE.search(text, end, end + REACH)
            last, at = stop.start() if stop else end + REACH, end
            while (m := _ASSIGNED.search(text, at)) if at <= last else None:
                if m.start() > last:
                    break
                found.add(_value(m))
                at = m.start() + 1
    return sorted((a, b) for a, b in found if b - a >= 8)


def _uncovered(start: int, end: int, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The stretches of start to end that no span covers."""
    out = []
    for s, _, e in sorted(spans):
        if s < end and start < e:
            if s > start:
                out.append((start, s))
            start = max(start, e)
    return out + [(start, end)] if start < end else out


def scan(text: str, novelty: Novelty | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(spans of the fixed forms, all spans), each as (start, kind, end) in order."""
    base = known_spans(text)
    novelty = novelty or Novelty()
    more: list[tuple[int, int, int]] = []
    for a, b in candidates(text):
        rest = _uncovered(a, b, base + more)
        # What stands in one string with a known form belongs to it if the string or the rest is new.
        if rest and (novelty.is_new(text, a, b) or any(y - x >= 8 and novelty.is_new(text, x, y) for x, y in rest)):
            more += [(x, len(KINDS), y) for x, y in rest]
    return base, sorted(base + more) if more else base


def costs(text: str, spans: list[tuple[int, int, int]], novelty: Novelty | None = None) -> list[int]:
    """Marginal bytes of each span; of an assignment, of its value."""
    novelty, out = novelty or Novelty(), []
    for s, k, e in spans:
        if k < len(KINDS) and KINDS[k][2]:
            s = KINDS[k][1].match(text, s).start(KINDS[k][2])
        out.append(novelty.cost(text[s:e], text[max(0, s - novelty.around) : s] + text[e : e + novelty.around]))
    return out


def shown(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end, joined by commas."""
    return ",".join(f"{_NAMES[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """text with the stretches that spans cover replaced by the mark."""
    out, at, end = [], 0, -1
    for s, _, e in spans:
        if s >= end:
            out += [text[at : max(s, at)], mark]
        at = end = max(end, e)
    return "".join(out) + text[at:] if spans else text


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, findings, base): findings are (kind, start, end, value, cost) structs of all spans, cost being the marginal bytes; base is how they are shown without the novel ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("cost", pa.int32())]))
        for part in tb.slices(batches, "text"):
            found, base = [], []
            for text in part["text"].to_pylist():
                own, spans = scan(text or "")
                base.append(shown(own))
                found.append([{"kind": _NAMES[k], "start": s, "end": e, "value": text[s:e], "cost": c} for (s, k, e), c in zip(spans, costs(text, spans) if spans else ())])
            yield pa.RecordBatch.from_arrays([part["id"], pa.array(found, kind), pa.array(base, pa.string())], names=["id", "findings", "base"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, findings array<struct<kind:string,start:bigint,end:bigint,value:string,cost:int>>, base string")


def without_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with every finding in the text replaced by a mark; length_col, if docs has it, is the new length of changed texts."""
    names = docs.columns
    at = names.index(text_col)
    measure = names.index(length_col) if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches, text_col):
            texts = part.column(at).to_pylist()
            clean = [None if t is None else redacted(t, scan(t)[1]) for t in texts]
            columns = list(part.columns)
            columns[at] = pa.array(clean, part.schema.field(at).type)
            if measure is not None:
                old = columns[measure].to_pylist()
                columns[measure] = pa.array([n if a == b else len(b) for n, a, b in zip(old, texts, clean)], part.schema.field(measure).type)
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    spans = F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    return got.select(F.col("id").alias("doc_id"), of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"), F.array_join(F.transform("findings", lambda f: f["cost"].cast("string")), ",").alias("marginal_bytes"))


QUERIES = {"op2_secret_scan": op2_secret_scan}
