"""Queries without SQL against versions of their own, written from the contracts with plain Python and the tokenizers' libraries."""

from __future__ import annotations

import bisect
import calendar
import collections
import datetime
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridwake.llm import bpe_codec, decontamination, language_model, near_dedup, pii_pseudonyms, quality_rules, rans_output, secret_scan, token_counts, warc_files
from gridwake.plans.materialize import new_path

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _documents(spark, sf):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# --- op2 ----------------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def _base_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def test_base_spans_of_whole_tables(spark, sf):
    names = ("assign", "access", "hex")
    docs = _documents(spark, sf)
    got = secret_scan.op2_secret_scan(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        own = _base_spans(docs[r["doc_id"]]["text"] or "")
        shown = [f"{names[k]}:{s}:{e}" for s, k, e in own]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == j for _, k, _ in own) for j in range(3))
        assert r["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(shown) <= set(spans) and spans == sorted(spans, key=lambda x: (int(x.split(":")[1]), ("assign", "access", "hex", "novel").index(x.split(":")[0])))


def test_planted_secrets_without_a_known_form(spark):
    """Strings at random behind sensitive names are found and words there are not; neither is a string at random elsewhere."""
    rng = random.Random(11)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    heads = ('signing_key = "', "DB_PASS=", "credential -> ", "client_secret => ", "Authorization: Bearer ", "encryptionKey := ", "session cookie: ", "private_key: ")
    words = ("configuration", "development_environment", "user_account_name", "repository_path", "disabled_by_default", "load_from_database", "application_name", "undefined_value")
    filler = "this module reads the settings of a service and returns what the client asked for "
    rows, want = [], {}
    for k in range(320):
        head, planted = heads[k % 8], k % 2 == 0
        value = "".join(rng.choice(letters) for _ in range(rng.randint(16, 40))) if planted else rng.choice(words) + "_" + rng.choice(words)
        text = filler * rng.randint(1, 4) + head + value + " and " + filler
        rows.append((k, text))
        if planted:
            want[k] = (text.index(head + value) + len(head), len(value))
    found = {}
    for r in secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found[r["id"]] = [(f["start"], f["end"] - f["start"]) for f in r["findings"] if f["kind"] == "novel"]
    hit = sum(want[k] in found[k] for k in want)
    false = sum(len(v) for k, v in found.items() if k not in want)
    assert hit / len(want) >= 0.97 and hit / (hit + false) >= 0.95
    # Long names, words and lines between, and values of any characters.
    signs = letters + "!@#$%^&*~?+/_.=-"
    heads = (
        'db_password_for_the_production_environment_of_customer_seven = "', "secret phrase for the administrators account is ", "API token (prod): ", "The passphrase is ", "password: ", "access key of the new bucket, given out today:\n    ",
        "`client_secret` of our tenant -> ", "credentials for staging := '",
    )
    rows, want = [], {}
    for k in range(320):
        head, planted = heads[k % 8], k % 2 == 0
        value = rng.choice(letters) + "".join(rng.choice(signs) for _ in range(rng.randint(12, 30))) + rng.choice(letters) if planted else rng.choice(words) + "_" + rng.choice(words)
        close = {'"': '"', "'": "'"}.get(head[-1], "")
        text = filler * rng.randint(1, 4) + head + value + close + " and " + filler
        rows.append((k, text))
        if planted:
            want[k] = (text.index(head + value) + len(head), len(value))
    found, costs = {}, []
    for r in secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found[r["id"]] = [(f["start"], f["end"] - f["start"]) for f in r["findings"] if f["kind"] == "novel"]
        costs += [(f["value"], f["cost"]) for f in r["findings"] if f["kind"] == "novel"]
    # A value may begin or end with what a known form has taken.
    covered = {r["id"]: [(f["start"], f["end"]) for f in r["findings"]] for r in secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = sum(all(any(s <= x < e for s, e in covered[k]) for x in range(at, at + n)) for k, (at, n) in want.items())
    false = sum(len(v) for k, v in found.items() if k not in want)
    assert hit / len(want) >= 0.97 and hit / (hit + false) >= 0.95
    assert costs and all(c >= 0.62 * len(v) for v, c in costs if any(x.isdigit() for x in v))
    calm = [(0, filler + "".join(rng.choice(letters) for _ in range(30)) + " " + filler)]
    assert secret_scan.find_secrets(spark.createDataFrame(calm, "doc_id long, text string")).first()["findings"] == []


# --- op3 ----------------------------------------------------------------------------------------------------------


def test_frames_ascend_over_the_files(spark, sf):
    """Many parts: starts ascend file by file in the order of names, and ids of any type are kept."""
    folder = new_path(spark, "rans")
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(7).withColumn("name", F.format_string("doc-%06d", "doc_id"))
    rans_output.write_ids(docs, folder, bpe_codec.default_path(), "name")
    rows = spark.read.parquet(f"{folder}/frames").select(F.input_file_name().alias("file"), "start", "ids").collect()
    by_file = collections.defaultdict(list)
    for r in rows:
        by_file[r["file"]].append(r["start"])
    order = [s for f in sorted(by_file) for s in by_file[f]]
    assert order == sorted(order) and len(order) == len(set(order))
    got = rans_output.read_ids(spark, folder).orderBy("start").collect()
    assert [r["id"] for r in got] == sorted(f"doc-{k:06d}" for k in _documents(spark, sf))
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]


def test_token_ids_of_whole_tables(spark, sf):
    library, docs = bpe_codec.vocabulary(bpe_codec.default_path()).library, _documents(spark, sf)
    got, start = {r["doc_id"]: r for r in rans_output.op3_rans_output(spark, sf).collect()}, 0
    for k in sorted(docs):
        ids = [*library.encode(docs[k]["text"] or "", add_special_tokens=False).ids, 2]
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


# --- op5, op9 -----------------------------------------------------------------------------------------------------


def test_counts_of_whole_tables(spark, sf):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = _documents(spark, sf)
    for r in token_counts.op5_token_counts(spark, sf).collect():
        text = docs[r["doc_id"]]["text"] or ""
        n = len(library.encode(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 4096)


def test_digests_of_whole_tables(spark, sf):
    library, docs = bpe_codec.vocabulary(bpe_codec.default_path()).library, _documents(spark, sf)
    for r in bpe_codec.op9_bpe_codec(spark, sf).collect():
        ids = library.encode(docs[r["doc_id"]]["text"] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_the_cache_of_pretokens_changes_nothing():
    import pyarrow as pa

    vocab = bpe_codec.Vocabulary(bpe_codec.default_path())
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(60)]
    want = [vocab.library.encode(t, add_special_tokens=False).ids for t in texts]
    for most in (10, 200, 10**6):
        vocab.cached = bpe_codec.Cache(most)
        for _ in range(2):
            for k in range(0, 60, 7):
                ids, n = vocab.encode(pa.array(texts[k : k + 7]))
                assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want[k : k + 7]
        assert len(vocab.cached.key) <= max(most, 400)


# --- op6 ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("order", [1, 2])
def test_scores_are_an_exact_interpolation(spark, sf, order, monkeypatch):
    """With given weights the score is the interpolation to the last digits; weights learned from exact estimates give scores within 1 %."""
    docs = _documents(spark, sf)
    tokens = {k: [*WORD.findall((r["text"] or "").translate(LOW)), "</s>"] for k, r in docs.items()}
    train = [t for k, t in tokens.items() if zlib.crc32(str(k).encode()) % 7 != 2]
    one, two, before = collections.Counter(), collections.Counter(), collections.Counter()
    for t in train:
        one.update(t)
        pairs = list(zip(["<s>", *t], t))
        two.update(pairs)
        before.update(a for a, _ in pairs)
    n, v = sum(one.values()), len(one)
    bucket = lambda c: 0 if c <= 0 else min(math.ceil(math.log2(c + 1)), language_model.BUCKETS - 1)

    def estimates(a, w, own=0):
        """The uniform share and each order's estimate, with `own` occurrences taken out."""
        p = [1 / (v + 1), (one[w] - own) / (n - own)]
        if order > 1:
            p.append((two[a, w] - own) / (before[a] - own) if before[a] > own else 0.0)
        return bucket(before[a] - own) if order > 1 else 0, p

    def score(t, weights):
        return sum(math.log10(sum(x * y for x, y in zip(weights[b], p))) for b, p in (estimates(a, w) for a, w in zip(["<s>", *t], t)))

    path = new_path(spark, "lm")
    spark.read.parquet(f"{sf}/documents.parquet").repartition(3).write.parquet(path)
    table = spark.read.parquet(path)
    fixed = np.array([[0.2 + 0.01 * b, *([0.8 - 0.01 * b] if order == 1 else [0.3, 0.5 - 0.01 * b])] for b in range(language_model.BUCKETS)])
    learn = language_model.learn_weights
    monkeypatch.setattr(language_model, "learn_weights", lambda *a: fixed)
    for r in language_model.scores(table, order=order).collect():
        assert math.isclose(r["score"], score(tokens[r["id"]], fixed), rel_tol=1e-9)
    monkeypatch.setattr(language_model, "learn_weights", learn)

    cases = collections.defaultdict(list)
    for t in train:
        for a, w in zip(["<s>", *t], t):
            b, p = estimates(a, w, 1)
            cases[b].append(p)
    weights = {b: [1 / (order + 1)] * (order + 1) for b in range(language_model.BUCKETS)}
    for b, rows in cases.items():
        p, w = np.array(rows), np.full(order + 1, 1 / (order + 1))
        for _ in range(100):
            part = p * w
            w = (part / part.sum(axis=1, keepdims=True)).mean(axis=0)
        weights[b] = w
    got = language_model.scores(table, order=order).collect()
    for r in got:
        assert math.isclose(r["score"], score(tokens[r["id"]], weights), rel_tol=0.01)
    assert len(got) == len(docs)


# --- op8 ----------------------------------------------------------------------------------------------------------

MONTHS = list(calendar.month_name)
FORMS = (("%Y-%m-%d", r"(\d{4})-(\d\d)-(\d\d)", "ymd"), ("%Y/%m/%d", r"(\d{4})/(\d\d)/(\d\d)", "ymd"), ("%Y.%m.%d", r"(\d{4})\.(\d\d)\.(\d\d)", "ymd"), ("%d.%m.%Y", r"(\d\d)\.(\d\d)\.(\d{4})", "dmy"), ("%m/%d/%Y", r"(\d\d)/(\d\d)/(\d{4})", "mdy"))


class Pseudonyms:
    """The permutations by plain Python: halves by big-endian digits and SHA-256."""

    def __init__(self, key):
        self.key = key

    def network(self, l, r, wide, narrow, kind, size):
        for k in range(6):
            half = r if k % 2 == 0 else l
            h = int(hashlib.sha256("|".join((self.key, kind, str(size), str(k), str(half))).encode()).hexdigest()[:12], 16)
            if k % 2 == 0:
                l = (l + h % wide) % wide
            else:
                r = (r + h % narrow) % narrow
        return l, r

    def digits(self, d, kind):
        h = len(d) // 2
        l, r = self.network(int(d[:h]), int(d[h:]), 10**h, 10 ** (len(d) - h), kind, len(d))
        return f"{l:0{h}d}{r:0{len(d) - h}d}"

    def day(self, d):
        n = (d - datetime.date(1800, 1, 1)).days
        a, b = self.network(n // 773, n % 773, 189, 773, "date", 1)
        return datetime.date(1800, 1, 1) + datetime.timedelta(a * 773 + b)

    def date(self, v):
        for _, pattern, order in FORMS:
            if m := re.fullmatch(pattern, v):
                part = dict(zip(order, map(int, m.groups())))
                try:
                    new = self.day(datetime.date(part["y"], part["m"], part["d"]))
                except ValueError:
                    return v
                text = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
                sep = re.search(r"[-/.]", v)[0]
                return sep.join(text[c] for c in order)
        if m := re.fullmatch(r"(\d{1,2}) ([A-Z][a-z]+) (\d{4})|([A-Z][a-z]+) (\d{1,2}), (\d{4})", v):
            d, name, y = (m[1], m[2], m[3]) if m[1] else (m[5], m[4], m[6])
            month = next(k for k in range(1, 13) if MONTHS[k].startswith(name))
            try:
                new = self.day(datetime.date(int(y), month, int(d)))
            except ValueError:
                return v
            full = MONTHS[new.month] if name in MONTHS else MONTHS[new.month][:3]
            return f"{new.day} {full} {new.year}" if m[1] else f"{full} {new.day}, {new.year}"
        return None

    def mail(self, v):
        alphabet = "abcdefghijklmnopqrstuvwxyz0123456789"
        name, domain = v.split("@")
        name = name.lower()
        own = "".join(c for c in name if c in alphabet)
        l, r = own[: len(own) // 2], own[len(own) // 2 :]
        for k in range(6):
            half = r if k % 2 == 0 else l
            h = bytes.fromhex(hashlib.sha256("|".join((self.key, "email", domain.lower(), str(len(own)), str(k), half)).encode()).hexdigest())
            moved = "".join(alphabet[(alphabet.index(c) + b) % 36] for c, b in zip(l if k % 2 == 0 else r, h))
            l, r = (moved, r) if k % 2 == 0 else (l, moved)
        it = iter(l + r)
        return "".join(next(it) if c in alphabet else c for c in name) + "@" + domain

    @staticmethod
    def refill(v, digits):
        it = iter(digits)
        return "".join(next(it) if c.isdigit() else c for c in v)

    @staticmethod
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    def value(self, v):
        digits = re.sub("[^0-9]", "", v)
        if "@" in v:
            return self.mail(v)
        if (date := self.date(v)) is not None:
            return date
        if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", v):
            p = [int(x) for x in v.split(".")]
            if max(p) > 255:
                return v
            l, r = self.network(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, "ip", 4)
            return f"{l // 256}.{l % 256}.{r // 256}.{r % 256}"
        if re.fullmatch(r"\d{3}-\d{2}-\d{4}", v):
            a, g, s = (int(x) for x in v.split("-"))
            if a in (0, 666) or a >= 900 or not g or not s:
                return v
            areas = [x for x in range(1, 900) if x != 666]
            l, r = self.network(bisect.bisect_left(areas, a), (g - 1) * 9999 + s - 1, 898, 99 * 9999, "ssn", 9)
            return f"{areas[l]:03d}-{r // 9999 + 1:02d}-{r % 9999 + 1:04d}"
        if v[0] in "+(" or re.fullmatch(r"(1-)?\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}", v):
            code = len(re.match(r"\+(\d{1,3})", v)[1]) if v[0] == "+" else 0
            if not 7 <= len(digits) - code <= 14:
                return v
            return self.refill(v, digits[:code] + self.digits(digits[code:], "phone"))
        if not 13 <= len(digits) <= 19 or not self.luhn(digits):
            return v
        head = digits[:6] + self.digits(digits[6:-1], "card")
        return self.refill(v, head + next(c for c in "0123456789" if self.luhn(head + c)))

    def text(self, t):
        return None if t is None else re.sub(pii_pseudonyms.ANY, lambda m: self.value(m[0]), t)


def _personal(rng):
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    card = d(15)
    card += next(c for c in "0123456789" if Pseudonyms.luhn(card + c))
    amex = d(14)
    amex += next(c for c in "0123456789" if Pseudonyms.luhn(amex + c))
    day = datetime.date(1800, 1, 1) + datetime.timedelta(rng.randrange(146097))
    month = MONTHS[day.month]
    return rng.choice([
        card, " ".join(card[k : k + 4] for k in range(0, 16, 4)), f"{amex[:4]}-{amex[4:10]}-{amex[10:]}", d(16), f"{d(3)}-{d(2)}-{d(4)}", ".".join(str(rng.randrange(300)) for _ in range(4)),
        f"+{d(2)} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{d(2)} {d(3)} {d(4)}", f"Jo.{d(2)}@Mail-{d(1)}.example.org",
        *(day.strftime(f) for f, _, _ in FORMS), f"{day.day} {month} {day.year}", f"{day.day} {month[:3]} {day.year}", f"{month} {day.day}, {day.year}", "2023-02-30", "31.04.1999", d(30), f"v{d(2)}.{d(2)}.1999", f"{d(1)}.{d(3)}",
    ])


def test_pseudonyms_against_plain_python(spark, sf):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(("call", "tel.", "on", "(", "id:", "x", "é")) + rng.choice(("", " ", "-", ".")) + _personal(rng) + rng.choice(("", ".", ",", ")", "x", "-")) for _ in range(12))) for k in range(400)]
    rows += [(None, None), (900, ""), (900, "4539148803436467 " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    own = Pseudonyms("key of the test")
    got = pii_pseudonyms.pseudonymise(df, "key of the test", found="found").collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter((i, own.text(t)) for i, t in rows)
    changed = collections.Counter(f["kind"] for r in got for f in r["found"] or [] if f["value"] != f["pseudonym"])
    assert set(changed) == {"email", "date", "ip", "ssn", "phone", "card"} and min(changed.values()) > 50
    docs, query = _documents(spark, sf), Pseudonyms("the query's own key, known to all")
    for r in pii_pseudonyms.op8_pii_pseudonyms(spark, sf).collect():
        assert r["text"] == query.text(docs[r["doc_id"]]["text"] or "")


def test_pseudonyms_stay_valid_and_turn_back(spark):
    """A sample of 100,000 valid social security numbers: pseudonyms are valid, distinct, and give the number back; one day has one pseudonym in all forms."""
    n = F.xxhash64("id")
    part = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m))
    area = part(1, 898)
    v = F.format_string("%03d-%02d-%04d", area + F.when(area >= 665, 2).otherwise(1), part(2, 99) + 1, part(3, 9999) + 1)
    df = spark.range(100_000).select(v.alias("v")).distinct().withColumn("p", pii_pseudonyms.pseudonym(F.col("v"), "k")).withColumn("back", pii_pseudonyms.pseudonym(F.col("p"), "k", True))
    valid = ~F.substring("p", 1, 3).isin("000", "666") & (F.substring("p", 1, 1) != "9") & (F.substring("p", 5, 2) != "00") & (F.substring("p", 8, 4) != "0000")
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p").alias("d"), F.count_if(valid).alias("ok"), F.count_if(F.col("back") == F.col("v")).alias("same"), F.count_if(F.col("p") == F.col("v")).alias("fixed")).first()
    assert r["d"] == r["ok"] == r["same"] == r["n"] and r["fixed"] < 5
    forms = spark.createDataFrame([(x,) for x in ("1999-12-31", "1999/12/31", "31.12.1999", "12/31/1999", "31 December 1999", "31 Dec 1999", "December 31, 1999")], "v string")
    got = [r["p"] for r in forms.select(pii_pseudonyms.pseudonym(F.col("v"), "k").alias("p")).collect()]
    day = datetime.date.fromisoformat(got[0])
    assert got[1:] == [day.strftime("%Y/%m/%d"), day.strftime("%d.%m.%Y"), day.strftime("%m/%d/%Y"), f"{day.day} {day:%B} {day.year}", f"{day.day} {day:%b} {day.year}", f"{day:%B} {day.day}, {day.year}"]
    with pytest.raises(ValueError):
        pii_pseudonyms.pseudonymise(forms, "", "v")
    assert n is not None


# --- the pipeline -------------------------------------------------------------------------------------------------


def _quality(rows):
    """Ids that the rules and the hosts' verdicts keep."""
    flags, hosts = {}, collections.defaultdict(list)
    for i, text, host in rows:
        text = text or ""
        w = WORD.findall(text)
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        again = {k + j for k in range(len(w) - 2) if tri[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
        signs = sum(text.count(c) for c in "#*$%&|<>")
        full = [x for x in text.split("\n") if WORD.search(x)]
        base = len(w) < 50 or 100 * len(again) > 50 * len(w)
        gross = 100 * signs > 50 * len(w)
        failed = base or gross or 100 * signs > 10 * len(w) or 100 * (len(full) - len(set(full))) > 30 * len(full)
        flags[i] = (base or gross, failed, host)
        hosts[host].append(failed)
    rates = [sum(x) / len(x) for x in hosts.values()]
    m = sum(rates) / len(rates)
    var = sum((x - m) ** 2 for x in rates) / len(rates)
    s = min(1000.0, max(1.0, m * (1 - m) / var - 1)) if var > 0 else 1000.0
    bad = {h for h, x in hosts.items() if (sum(x) + m * s) / (len(x) + s) > 0.6}
    return {i for i, (gone, failed, host) in flags.items() if not gone and not (failed and host in bad)}


def _distinct(rows):
    """The smallest id of each group of near duplicates, by all pairs."""
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in sets if find(i) == i}


def _clean(text, windows):
    w = PLAIN.findall((text or "").translate(LOW))
    return not any(tuple(w[k : k + n]) in windows[n] for n in windows for k in range(len(w) - n + 1))


def test_pipeline_against_brute_force(spark, sf):
    docs = _documents(spark, sf)
    good = _quality([(k, r["text"], r["source"]) for k, r in docs.items()])
    single = _distinct([(k, docs[k]["text"]) for k in sorted(good)])
    windows = collections.defaultdict(set)
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = PLAIN.findall((r["text"] or "").translate(LOW))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[min(len(w), 10)].add(tuple(w[k : k + 10]))
    clean = {k for k in single if _clean(docs[k]["text"], windows)}
    library = bpe_codec.vocabulary(bpe_codec.default_path()).library
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == clean and 0 < len(clean) < len(single) < len(good) < len(docs)
    for k in clean:
        text, out, at = docs[k]["text"] or "", [], -1
        # Novel spans are the operator's own; the known forms and the mark are not.
        for s, _, e in sorted(set(_base_spans(text)) | set(secret_scan.scan(text)[1])):
            if s >= at:
                out.append((s, e))
            else:
                out[-1] = (out[-1][0], max(at, e))
            at = max(at, e)
        for s, e in reversed(out):
            text = text[:s] + "[secret]" + text[e:]
        assert list(got[k]["ids"]) == library.encode(text, add_special_tokens=False).ids and got[k]["n_tokens"] == len(got[k]["ids"])


def _odd(spark):
    """Nulls in every column, repeated ids and rows, empty and long texts, and columns that clash with the operators' own."""
    long = " ".join(f"word{k}" for k in range(20_000))
    prose = [" ".join(f"t{(k * 37 + j * j) % 900}" for j in range(90)) for k in range(6)]
    rows = [(k, t, "en", f"s{k % 2}", len(t)) for k, t in enumerate(prose)]
    rows += [(3, prose[0], "en", "s1", 1), (3, prose[5] + " more", "en", "s1", 1), (3, prose[3], "en", "s1", 1), (None, prose[1], None, None, None), (None, None, None, None, None), (8, "", "en", "s0", 0), (9, long, None, "s0", 5), (10, None, "en", None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in ("_hit_key", "_hit_id", "_gone_id", "_gone_key", "_pii_old", "_rule_kept", "id", "key", "ids", "fp", "found", "findings", "n_words", "held", "tie", "part", "host")})


def test_stages_on_odd_rows_and_none(spark, sf):
    """Every stage takes them, all but the last keep the columns, and an empty table goes through."""
    for docs in (_odd(spark), _odd(spark).where("false")):
        at = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, at, sf)
            assert out.columns == docs.columns, name
            assert out.count() <= at.count()
        last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        assert last.count() == docs.count()


def test_verdicts_are_by_row_and_not_by_id(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    docs = spark.createDataFrame([(1, a), (3, a), (3, b), (None, a)], "doc_id long, text string").withColumn("_gone_id", F.lit(1)).withColumn("_hit_key", F.lit(1))
    rows = lambda df: sorted((str(r["doc_id"]), r["text"][:1]) for r in df.collect())
    assert rows(near_dedup.keep_one(docs)) == [("1", "a"), ("3", "b"), ("None", "a")]
    items = spark.createDataFrame([(9, a[:60])], "item_id long, text string")
    assert rows(decontamination.keep_clean(docs, items)) == [("3", "b")]


def test_blocks_and_slop_end_with_their_document(spark, monkeypatch):
    text = " ".join(f"w{k}" for k in range(15)) + " a b c d e f"
    docs = spark.createDataFrame([(1, text), (2, "x " * 30)], "doc_id long, text string")
    items = spark.createDataFrame([(5, "a b c d e f"), (6, "w1 w2")], "item_id long, text string")
    key = lambda: sorted((r["id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontamination.document_hits(docs, items, slop=10).collect())
    once = key()
    monkeypatch.setattr(decontamination, "BLOCK", 1)
    assert key() == once and all(hit <= n for _, n, hit, _ in once)


def test_ids_of_other_types(spark):
    rows = [(f"d{k}", " ".join(f"w{(k // 2 * 50 + j) % 997}" for j in range(60))) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    path = new_path(spark, "strings")
    docs.write.parquet(path)
    docs = spark.read.parquet(path)
    items = spark.createDataFrame([(1, rows[0][1][:80])], "item_id long, text string")
    assert {(r["id"], r["component"]) for r in near_dedup.near_groups(docs).collect()} == {(f"d{k}", f"d{k // 2 * 2}") for k in range(8)}
    assert {r["id"] for r in decontamination.document_hits(docs, items).where("n_hit > 0").collect()} >= {"d0", "d1"}
    assert {r["id"] for r in language_model.scores(docs).collect()} == {r for r, _ in rows} == {r["id"] for r in token_counts.token_counts(docs, __import__("public_tokenizers").path("piece_bpe_32k.model")).collect()}
    assert near_dedup.keep_one(docs).count() == 4


def test_operators_on_odd_rows_and_empty_tables(spark):
    """Columns that clash, nulls and repeated rows; each operator gives a row for a row, and none for an empty table."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    path = bpe_codec.default_path()
    written = new_path(spark, "odd")
    _odd(spark).withColumnRenamed("id", "other").write.parquet(written)
    odd = spark.read.parquet(written)
    for docs in (odd, odd.where("false")):
        n = docs.count()
        assert quality_rules.judge(docs).count() == n
        assert secret_scan.find_secrets(docs).count() == n and secret_scan.without_secrets(docs).columns == docs.columns
        import sentencepiece

        library, rows = sentencepiece.SentencePieceProcessor(model_file=model), docs.collect()
        want = collections.Counter((r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or "", num_threads=1))) for r in rows)
        assert collections.Counter((r["id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(docs, model).collect()) == want
        known = docs.withColumn("text", F.when(F.col("doc_id") == 3, F.concat(F.lit("api_key = q9ZxT7LmPw3R "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")))
        spans = collections.Counter((r["doc_id"], secret_scan.shown(secret_scan.scan(r["text"] or "")[1])) for r in known.collect())
        assert collections.Counter((r["id"], ",".join(f"{f['kind']}:{f['start']}:{f['end']}" for f in r["findings"])) for r in secret_scan.find_secrets(known).collect()) == spans
        assert not n or any(s for _, s in spans)
        clean = collections.Counter((r["doc_id"], None if r["text"] is None else secret_scan.redacted(r["text"], secret_scan.scan(r["text"])[1])) for r in known.collect())
        assert collections.Counter((r["doc_id"], r["text"]) for r in secret_scan.without_secrets(known).collect()) == clean
        scored = language_model.scores(docs).collect()
        assert len(scored) == n and all(r["score"] < 0 for r in scored)
        assert len({(r["n_tokens"], r["score"]) for r in scored if r["n_tokens"] == 1}) <= 1
        assert pii_pseudonyms.pseudonymise(docs, "k").count() == n
        assert bpe_codec.digests(docs, path).count() == n
        assert near_dedup.near_groups(docs).count() == n
        folder = new_path(spark, "rans")
        rans_output.write_ids(docs, folder, path)
        assert rans_output.read_ids(spark, folder).count() == n
        pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), "key", "ids")
        archive = new_path(spark, "warc")
        warc_files.write_warc(pages, archive)
        assert warc_files.read_warc(spark, archive).count() == n
