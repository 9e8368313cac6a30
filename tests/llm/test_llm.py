"""The operators against plain single-process versions."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from textlake.llm import (
    decontam,
    encoders,
    langid,
    lmscore,
    packing,
    quality,
    shards,
    simhash,
    tokencount,
    urls,
    warc,
)
from textlake.llm.graph import components

from .conftest import DIR
from .test_jaccard import plain_groups as plain_similar

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def run(spark, name, directory=DIR) -> pd.DataFrame:
    return entry_points.queries()[name](spark, directory).toPandas()


def texts_of(df) -> list[tuple]:
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# --- WARC

def b32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plain_warc(pages, least=0):
    top = {}
    for i, html in pages:
        if len((html or "").encode()) >= least:
            top[html or ""] = max(top.get(html or "", i), i)
    out = []
    for i, html in pages:
        data = (html or "").encode()
        owner = top.get(html or "", i)
        out.append((i, len(data), b32(data), "response" if owner == i else "revisit", None if owner == i else owner))
    return sorted(out, key=repr)


def test_warc_query(spark):
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()]
    got = entry_points.queries()["op1_warc"](spark, DIR).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert rows(got) == plain_warc(pages)


AWKWARD = ["", None, "\r\n\r\n", "a\r\n\r\nb", "a\r\n", "\r\n", "\r\n\r\n\r\nWARC/1.0\r\nx", "a\r\n\r", "\r\r\n\r\n\r", "é\u0000😀", "same", "same",
           "x" * 200_000, "WARC/1.0\r\nContent-Length: 5\r\n\r\nabc", "\n\n", "a\r\n\r\n"]


@pytest.mark.parametrize("least", [0, 3])
def test_warc_awkward_payloads(spark, tmp_path, least):
    pages = spark.createDataFrame(
        [(i, None if i % 3 == 0 else f"http://h.x/p?{i}\r\nX: y", h, "extra") for i, h in enumerate(AWKWARD)],
        "page_id bigint, url string, html string, digest string").repartition(1)
    got = warc.archive_and_read(pages, str(tmp_path / "w"), least)
    assert rows(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == plain_warc(
        list(enumerate(AWKWARD)), least)
    assert all(r["n_requests"] == 1 for r in got.collect())
    data = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path / "w").glob("part-*"))
    assert data.count(b"WARC-Type: request") == len(AWKWARD)


def test_warc_payloads_come_back(spark, tmp_path):
    pages = spark.createDataFrame([(i, "http://a/b", h) for i, h in enumerate(AWKWARD)], "page_id bigint, url string, html string")
    warc.write_captures(pages, str(tmp_path / "w"))
    records = warc.read_records(spark, str(tmp_path / "w"))
    got = {r["block"].partition(b"\r\n\r\n")[2].decode() for r in records.where("kind = 'response'").collect()}
    assert got == {h or "" for h in AWKWARD}
    assert records.where("found_digest <> payload_digest").isEmpty()


def test_warc_repeated_rows_and_null_ids(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (None, "u", "b"), (None, None, None)], "page_id bigint, url string, html string")
    got = Counter(r["record_type"] for r in warc.archive_and_read(pages, str(tmp_path / "w")).collect())
    assert got == {"response": 3, "revisit": 1}
    assert warc.archive_and_read(pages.limit(0), str(tmp_path / "e")).count() == 0


def test_warc_assembly_follows_both_directions(spark):
    def record(i, kind, to=None):
        return (i, kind, None, None, to, None, None, None, None, None)
    records = spark.createDataFrame([
        record("r1", "response"), record("q1", "request", "r1"), record("m1", "metadata", "q1"),
        record("r2", "response", "q2"), record("q2", "request"), record("m2", "metadata", "r2"), record("m2", "metadata", "r2"),
        record("r3", "revisit"), record("m9", "metadata", "gone"), record(None, "request", "r3")], warc.RECORD)
    got = {r["capture_id"]: ([q["record_id"] for q in r["requests"]], [m["record_id"] for m in r["metadata"]])
           for r in warc.assemble(records).collect()}
    assert got == {"r1": (["q1"], ["m1"]), "r2": (["q2"], ["m2"]), "r3": ([], [])}
    assert warc.assemble(records.limit(0)).count() == 0


# --- url filters

def plain_url(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.translate(LOWER)
    best = None
    for rule, verdict in rules.items():
        h, slash, p = rule.partition("/")
        if host and (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            best = max(best or (-1,), (len(rule.encode()), len(h.encode()), rule, verdict))
    return host, path, best[2] if best else None, best[3] if best else default


def test_url_awkward(spark):
    rules = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "a.b/x": "block", "b/xyz": "allow",
             "exämple.org/ü": "block", "c": "block", "": "block"}
    given = [*rules.items(), ("twice/", "allow"), ("twice/", "block"), (None, "block"), ("bad/", "maybe")]
    index = urls.build_index(spark.createDataFrame(given, "rule string, verdict string"))
    pages = [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/70?x#y", "http://sub.example.com/en/8", "http://example.com/EN/7",
             "x://a.b/xyz", "x://A.B?q", "x://notcom/en/", "http://exämple.org/üü", "http://h.c", "http://twice/1", "http://bad/",
             "http://a\nb.com/en/\nq", "http://b.net:80/de/", "http://u/://v.com/en/", "http://" + "l." * 500 + "com/en/" + "p" * 5000]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(pages)] * 2, "page_id bigint, url string, host string")
    want = [(i, *plain_url(u, rules | {"twice/": "block"})) for i, u in enumerate(pages)] * 2
    assert rows(urls.judge_urls(df, index)) == sorted(want, key=repr)
    assert rows(urls.judge_urls(df, [])) == sorted(((i, *plain_url(u, {})) for i, u in [*enumerate(pages)] * 2), key=repr)
    assert urls.judge_urls(df.limit(0), index).count() == 0


def test_url_collisions_are_confirmed(monkeypatch, tmp_path):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda b: len(b))
    path = tmp_path / "i"
    path.write_bytes(urls.Index.pack([(b"aa/", "allow"), (b"bb/", "block"), (b"ccc/", "block")]))
    index = urls.Index(str(path))
    assert [(i, bytes(index.rules[int(index.starts[k]):int(index.starts[k + 1])])) for i, k in index.find([b"bb/", b"xx/", b"ccc/"])] == [
        (0, b"bb/"), (2, b"ccc/")]


# --- quality rules

def plain_base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    marked = set()
    for j in range(len(words) - 2):
        if windows[tuple(words[j:j + 3])] > 1:
            marked |= {j, j + 1, j + 2}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked),
            len(words) < 50 or 100 * len(marked) > 50 * len(words))


def test_quality_base(spark, wide, stored):
    for df in (wide, stored):
        got = quality.judge(df, quality.prior()).drop("kept", "content_share", "content_lines")
        assert rows(got) == sorted(((i, *plain_base(t)) for i, t in texts_of(df)), key=repr)
    assert quality.judge(wide.limit(0), quality.prior()).count() == 0


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(5)
    field = quality.Field(rng.normal(size=(len(quality.FEATURES), 2)) * 2, rng.normal(size=(2, 2)))
    texts = ["\n".join("w" * rng.integers(1, 9) + " ##" * rng.integers(0, 3) for _ in range(n)).encode() for n in (1, 2, 5, 7)]
    lines = quality.Lines([None, *texts[:2], b"  ", *texts[2:]])
    got = field.decode(lines)
    scores = lines.features @ field.emission
    for d in set(lines.doc[lines.lines].tolist()):
        at = np.flatnonzero(lines.doc[lines.lines] == d)
        best = max(range(2 ** len(at)), key=lambda code: sum(
            scores[i, code >> k & 1] + (field.transition[code >> (k - 1) & 1, code >> k & 1] if k else 0) for k, i in enumerate(at)))
        assert got[at].astype(int).tolist() == [best >> k & 1 for k in range(len(at))]


def test_quality_follows_labels(spark):
    directory = "/root/testdata/sf0.01"
    got = run(spark, "op3_line_crf", directory)
    known = pd.read_parquet(f"{directory}/labels.parquet").merge(got, on="doc_id")
    good, bad = (known[(known.quality == q) & ~known.base_failed] for q in (1, 0))
    assert good.kept.mean() > 0.97 and bad.kept.mean() < 0.1
    assert not got[got.base_failed].kept.any()


def test_quality_without_labels_uses_fixed_weights(spark, stored):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert np.array_equal(quality.train(stored, none).emission, quality.prior().emission)


# --- shards

def test_shards(spark, wide, stored):
    for df, count, size in ((wide, 3, 2), (stored, 8, 50), (stored, 8, 10**6), (wide, 40, 5)):
        got = shards.assign_shards(df, count, range_rows=size).toPandas()
        data = sorted(((i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in texts_of(df)))
        total, before, want, slots = sum(r[3] for r in data), 0, [], Counter()
        for known, i, crc, n in data:
            shard = (before + n - n // 2 - 1) * count // total
            before += n
            want.append((float(i) if known else None, n, crc, shard, slots[shard]))
            slots[shard] += 1
        have = [
            (None if pd.isna(a) else float(a), b, c, d, e) for a, b, c, d, e in got[["doc_id", "size", "text_crc32", "shard", "slot"]].itertuples(index=False)]
        assert sorted(have, key=repr) == sorted(want, key=repr)
    assert shards.assign_shards(wide.limit(0), 8).count() == 0


def test_shards_are_near_equal(spark):
    got = run(spark, "op4_byte_shards", "/root/testdata/sf0.01")
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 8 and sums.max() - sums.min() <= 2 * got["size"].max()


def test_written_shards(spark, stored, tmp_path):
    shards.write_shards(stored, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == stored.count() and back.select("shard").distinct().count() == 4


# --- SimHash

def plain_print(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints: dict[int, list]) -> dict[int, object]:
    keys = list(prints)
    group = {k: k for k in keys}

    def find(k):
        while group[k] != k:
            k = group[k]
        return k
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 4:
                group[find(a)] = find(b)
    least = {}
    for k in keys:
        ids = [d for d in prints[k] if d is not None]
        if ids:
            least[find(k)] = min(min(ids), least.get(find(k), min(ids)))
    return {k: least.get(find(k)) for k in keys}


def test_simhash(spark, wide, stored):
    for df in (wide, stored):
        prints: dict[int, list] = {}
        for i, t in texts_of(df):
            prints.setdefault(plain_print(t), []).append(i)
        groups = plain_groups(prints)
        want = sorted(((i, p, groups[p]) for p, ids in prints.items() for i in ids), key=repr)
        got = [(r[0], r[1] % (1 << 64), r[2]) for r in simhash.near_groups(df).collect()]
        assert sorted(got, key=repr) == want
    assert simhash.near_groups(wide.limit(0)).count() == 0


def test_links_by_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2 ** 63, 40, dtype=np.uint64)
    flips = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for b in base for n in (0, 1, 2, 3, 4, 5, 6)]
    close = sorted({*flips, *(int(base[0]) ^ (1 << k) for k in range(64)), 0, 1, 15, 31, 2 ** 64 - 1})
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in close]
    for distance in (4, 3, 2):
        got = simhash.links(spark.createDataFrame([(v,) for v in signed], "f bigint"), distance).collect()
        want = {(a, b) for i, b in enumerate(sorted(signed)) for a in sorted(signed)[:i]
                if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= distance}
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_variants_are_not_broadcast(spark, tmp_path):
    """Their size is taken for that of the fingerprints, of which there are 64 times fewer."""
    spark.range(2000).selectExpr("xxhash64(id) as f").write.parquet(f"{tmp_path}/f")
    found = simhash.links(spark.read.parquet(f"{tmp_path}/f"))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_keep_one(spark, wide):
    left = simhash.keep_one(wide)
    assert left.columns == wide.columns
    groups = {r["component_id"] for r in simhash.near_groups(wide).collect()}
    assert {r["doc_id"] for r in left.collect()} >= groups


@pytest.mark.parametrize("shape", ["chain", "star", "random", "empty"])
def test_components(spark, shape):
    rng = np.random.default_rng(7)
    edges = {"chain": [(i, i + 1) for i in range(200)], "star": [(0, i) for i in range(1, 300)],
             "random": [tuple(map(int, rng.integers(0, 400, 2))) for _ in range(260)] + [(5, 5), (1, 2), (2, 1)], "empty": []}[shape]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    group = {}
    for a, b in edges:
        if a != b:
            group.setdefault(a, {a}), group.setdefault(b, {b})
            if group[a] is not group[b]:
                both = group[a] | group[b]
                for k in both:
                    group[k] = both
    assert got == {k: min(v) for k, v in group.items()}


# --- language identification

def plain_phrases(text, corpus):
    count = at = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at:at + n + 1] in corpus:
            n += 1
        at += n
        count += 1
    return count


def test_phrases_are_longest_matches():
    samples = {"a": ["the cat sat on the mat the end"], "b": ["le chat est sur la table"]}
    model = langid.Model(samples)
    for text in ("the chat sat", "zzz le mat", "a", "sur la table est le chat sur le mat"):
        lowered = langid.letters()[langid.code_points(text)]
        symbols = langid.squeeze(model.symbols(lowered))
        rates = model.rates(symbols, np.array([0]), np.array([len(symbols)]))[:, 0]
        shown = "".join(chr(33 + s) for s in symbols)
        for k, lang in enumerate(model.languages):
            corpus = "".join(chr(33 + s) for s in langid.squeeze(model.symbols(langid.letters()[langid.code_points(" ".join(samples[lang]))])))
            assert round(rates[k] * len(symbols) / model.bits[k]) == plain_phrases(shown, corpus)


def test_language_accuracy(spark):
    directory = "/root/testdata/sf0.01"
    got = run(spark, "op6_cross_parsing", directory).merge(pd.read_parquet(f"{directory}/documents.parquet"), on="doc_id")
    assert got.score.between(0, 1).all() and len(got) == 1000
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    held = got[got.held_out & (got.lang_pred != "und")]
    assert (held.lang_pred == held.lang).mean() > 0.97


def test_language_awkward(spark, wide):
    model = langid.Model(langid.sample(wide))
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(wide, model).collect()]
    assert len(got) == wide.count()
    assert {i for i, p, s in got if p == "und" and s == 0} == {3, 4, 5, 6, None}
    assert [p for i, p, _ in got if i == 7] == ["fr"] and [p for i, p, _ in got if i == 1] == ["en"]
    none = langid.Model(langid.sample(wide.limit(0)))
    assert {r["lang_pred"] for r in langid.identify(wide, none).collect()} == {"und"}
    one = langid.Model({"en": ["some text"]})
    assert {r["lang_pred"] for r in langid.identify(wide, one).collect()} == {"und", "en"}
    assert langid.identify(wide.limit(0), model).count() == 0


# --- decontamination

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_hits(text, items, size=10):
    words = PLAIN.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, body in items:
        own = PLAIN.findall((body or "").translate(LOWER))
        windows = {tuple(own[i:i + size]) for i in range(max(1, len(own) - size + 1))} if own else set()
        for w in windows:
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i:i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    found.add(item)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 90])
def test_decontaminate(spark, block):
    long = "one two three four five six seven eight nine ten eleven twelve"
    items = [("1", long), ("2", "cat SAT"), ("3", "!!"), ("4", None), ("5", "two three four five six seven eight nine ten eleven"),
             ("6", "été 2024"), ("7", "a a"), ("2", "dog")]
    texts = [f"Zero {long.upper()} thirteen", "the cat, sat; a cat sat", "a a a b", None, "", "l'été--2024!", "cats at", "cat\nsat dog",
             long.replace(" ", "\t\t"), "x " * 3000 + long, "two three four five six seven eight nine ten"]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(1, texts[1], "z"), (None, "cat sat", "z")], "doc_id bigint, text string, items string")
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id string, text string, spans int")
    got = decontam.decontaminate(docs, bench, block_bytes=block)
    have = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got.collect()), key=repr)
    assert have == sorted(((i, *plain_hits(t, items)) for i, t in texts_of(docs)), key=repr)
    for r in got.collect():
        raw = (texts[r["doc_id"]] if r["doc_id"] is not None else "cat sat") or ""
        inside = sum(len(PLAIN.findall(raw.translate(LOWER).encode()[s["first"]:s["last"]].decode())) for s in r["spans"])
        assert inside == r["n_hit"] == sum(s["end_word"] - s["word"] for s in r["spans"])
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0
    assert all(r["n_hit"] == 0 for r in decontam.decontaminate(docs, bench.limit(0)).collect())


def test_decontaminate_query(spark, stored):
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    got = run(spark, "op7_decontaminate").set_index("doc_id")
    for i, t in texts_of(stored):
        n, hit, found = plain_hits(t, items)
        assert tuple(got.loc[i]) == (n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0)


# --- tokens and packing

@pytest.fixture(scope="module")
def byte_level():
    return encoders.ByteLevel(encoders.public("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def pieces():
    return encoders.Pieces(encoders.public("piece_bpe_32k.model"))


ODD = ["", "a  b", "\n\n a\n b", " x", "x ", "a<|endoftext|>b", "<s>a</s>", "a\tb", "é ñ b", "日本 語\n テ", "\x1ca", "▁a b", "don't 's it's",
       "a\n\n\nb", "\x00a", "a \n b", "a\u3000b", "\r\na", "\ufeffab c", "a\u00a0b", "x\x85y", "1 22 333\n4", "!!. ,,\n.."]


def random_texts(n=20_000):
    rng = np.random.default_rng(11)
    signs = list(" \n\t\r'sabté1., ▁<|日\x1c\x85\u200b")
    return ["".join(rng.choice(signs, rng.integers(0, 14))) for _ in range(n)]


def split_ids(encoder, texts):
    ids, counts = encoder.ids(texts)
    return [list(map(int, part)) for part in np.split(ids, np.cumsum(counts)[:-1])]


@pytest.mark.parametrize("memory", [encoders.MEMORY, 30])
def test_encoders_equal_their_libraries(monkeypatch, byte_level, pieces, stored, memory):
    monkeypatch.setattr(encoders, "MEMORY", memory)
    for texts in (ODD, random_texts(), [t or "" for _, t in texts_of(stored)]):
        assert split_ids(byte_level, texts) == byte_level.whole(texts)
        assert pieces.counts(texts).tolist() == pieces.whole(texts)


def test_counts_and_cache(spark, wide, pieces, tmp_path, monkeypatch):
    path, cache = encoders.public("piece_bpe_32k.model"), str(tmp_path / "cache")
    want = sorted(((i, len((t or "").encode()), n, n > 20) for (i, t), n in zip(
        texts_of(wide), pieces.whole([t or "" for _, t in texts_of(wide)]), strict=True)), key=repr)
    assert rows(tokencount.count_tokens(wide, path, cache, 20)) == want
    distinct = len({t or "" for _, t in texts_of(wide)})
    assert tokencount.read_cache(spark, cache).count() == distinct
    assert rows(tokencount.count_tokens(wide, path, cache, 20)) == want
    assert tokencount.read_cache(spark, cache).count() == distinct
    other = encoders.public("byte_bpe_50k.json")
    tokencount.count_tokens(wide, other, cache).count()
    assert tokencount.read_cache(spark, cache).count() == 2 * distinct
    assert tokencount.count_tokens(wide.limit(0), path, str(tmp_path / "none")).count() == 0


def check_packing(got, docs, byte_level, length=1024):
    ids = {i: [*row, 2] for (i, _), row in zip(docs, byte_level.whole([t or "" for _, t in docs]), strict=True)}
    for i, part in got.groupby("doc_id"):
        own, at = ids[i], 0
        part = part.sort_values("piece")
        assert part.piece.tolist() == list(range(-(-len(own) // length)))
        for p in part.itertuples():
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(own[at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(own) and (part.length[1:] == length).all()
    assert set(got.doc_id) == set(ids)
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]] and part.length.sum() <= length
    return got.sequence_id.nunique(), -(-got.length.sum() // length)


def test_packing_query(spark, stored, byte_level):
    used, bound = check_packing(run(spark, "op8_pattern_packing"), texts_of(stored), byte_level)
    assert used <= bound + 3


def test_packing_awkward(spark, wide, byte_level):
    unique = wide.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = packing.pack(unique, encoders.public("byte_bpe_50k.json")).toPandas()
    check_packing(got, texts_of(unique), byte_level)
    every = packing.pack(wide, encoders.public("byte_bpe_50k.json")).toPandas()
    assert every[every.doc_id.isna()].shape[0] == 2 and (every.doc_id == 2).sum() == 2
    assert packing.pack(wide.limit(0), encoders.public("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 60, 3000])
def test_plan_places_every_length(n):
    rng = np.random.default_rng(n)
    histogram = np.bincount(np.minimum(256, rng.gamma(1.2, 90, n).astype(int) + 1), minlength=257)
    made = packing.plan(histogram, 256)
    placed = np.zeros(257, np.int64)
    for pattern, times in made:
        assert sum(pattern) <= 256 and times > 0
        for k in pattern:
            placed[k] += times
    assert (placed == histogram).all()
    bound = -(-int((histogram * np.arange(257)).sum()) // 256)
    assert sum(t for _, t in made) <= bound * 1.02 + 1


# --- language-model scores

def plain_scores(docs, codes_of):
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in docs}
    words = {k: [w.encode() for w in WORD.findall((t or "").translate(LOWER))] for k, (_, t) in enumerate(docs)}
    counts = Counter()
    for k, (i, _) in enumerate(docs):
        if not held[i]:
            counts.update([*words[k], b""])
    total, kinds = sum(counts.values()), len(counts)
    norm = math.log10(total + 0.5 * (kinds + 1))
    out = []
    for k, (i, _) in enumerate(docs):
        tokens = [*words[k], b""]
        base = sum(math.log10(counts[w] + 0.5) - norm for w in tokens)
        out.append((i, held[i], len(tokens), sum(w in counts for w in tokens), total, base))
    return out


@pytest.mark.parametrize("head", [lmscore.HEAD_WORDS, 5])
def test_base_scores(spark, wide, stored, monkeypatch, head):
    monkeypatch.setattr(lmscore, "HEAD_WORDS", head)
    for df in (wide, stored):
        got = sorted((tuple(r)[:6] for r in lmscore.score_held_out(df).collect()), key=repr)
        want = sorted(plain_scores(texts_of(df), None), key=repr)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert all(abs(g[5] - w[5]) < 1e-7 * (1 + abs(w[5])) for g, w in zip(got, want, strict=True))
    assert lmscore.score_held_out(wide.limit(0)).count() == 0


def test_automaton_against_recursion(spark, stored):
    """Scores equal interpolated Witten-Bell probabilities computed symbol by symbol."""
    model = lmscore.learn(stored, least_share=2e-4)
    automaton = model.automaton
    grams = {k: Counter() for k in range(1, 7)}
    symbols_of = {}
    for i, t in texts_of(stored):
        run_ = lmscore.Stream(lmscore.split([(t or "").encode()]), automaton.key)
        s = run_.symbols.tolist()
        symbols_of[i] = s
        for j in range(5, len(s)):
            for k in range(1, 7):
                grams[k][tuple(s[j - k + 1:j + 1])] += 1
    context = {k: Counter() for k in range(0, 6)}
    types = {k: Counter() for k in range(0, 6)}
    for k in range(1, 7):
        for g, n in grams[k].items():
            context[k - 1][g[:-1]] += n
            types[k - 1][g[:-1]] += 1
    total = sum(grams[1].values())

    def p(history, symbol):
        if not history:
            return (grams[1][(symbol,)] + 0.5) / (total + 0.5 * 64)
        low = p(history[1:], symbol)
        n, k = context[len(history)][history], types[len(history)][history]
        if n == 0 or (len(history) > 2 and n < 2e-4 * total):
            return low
        return (grams[len(history) + 1][(*history, symbol)] + k * low) / (n + k)

    for i, t in texts_of(stored)[:8]:
        s = symbols_of[i][:3000]
        want = sum(math.log10(p(tuple(s[j - 5:j]), s[j])) for j in range(5, len(s)))
        if len(s) == len(symbols_of[i]):
            want += sum(automaton.inner[b] for w in lmscore.split([(t or "").encode()])[0] for b in w if automaton.key[b] == 63)
            got = automaton.tokens(lmscore.split([(t or "").encode()])).sum()
            assert abs(got - want) < 1e-4 * (1 + abs(want))
    rows_ = 10.0 ** automaton.arcs["weight"].reshape(-1, 64).astype(float)
    assert np.allclose(rows_.sum(axis=1), 1, atol=1e-4)


@pytest.mark.parametrize("head", [lmscore.HEAD_WORDS, 5])
def test_scores_mix_spelling_and_share(spark, wide, monkeypatch, head):
    """Each token: its share of the training tokens, mixed with what the automaton gives its
    symbols; long words and words outside the head like any other."""
    share = lmscore.WORD_WEIGHT
    monkeypatch.setattr(lmscore, "HEAD_WORDS", head)
    model = lmscore.learn(wide)
    got = sorted((r["n_tokens"], r["score"]) for r in lmscore.score(wide, model).collect())
    lists = [lmscore.split([(t or "").encode()])[0] for _, t in texts_of(wide)]
    counts = Counter(w for t in lists for w in [*t, b""])
    total = sum(counts.values())
    want = []
    for t in lists:
        own = model.automaton.tokens([t]).tolist()
        want.append((len(t) + 1, sum(
            math.log10(share * counts[w] / total + (1 - share) * 10.0 ** x) if x > -300 and counts[w] else
            x + math.log10(1 - share) if not counts[w] else math.log10(share * counts[w] / total)
            for w, x in zip([*t, b""], own, strict=True))))
    assert [g[0] for g in got] == [w[0] for w in sorted(want)]
    assert all(abs(g[1] - w[1]) < 1e-6 * (1 + abs(w[1])) for g, w in zip(got, sorted(want), strict=True))
    # words that were never learned have the automaton's part alone, whatever their length
    empty = lmscore.learn(wide.limit(0))
    for r in lmscore.score(wide, empty).collect():
        assert r["score"] < 0 and r["n_known"] == 0
    known = lmscore.score(wide.where("doc_id = 7"), model).first()["score"]
    other = lmscore.learn(wide.where("doc_id = 1"))
    assert lmscore.score(wide.where("doc_id = 7"), other).first()["score"] < known


@pytest.mark.parametrize("arcs", [lmscore.HEAD_ARCS, 40, 0])
def test_rare_contexts_keep_their_arcs(spark, monkeypatch, arcs):
    """Only contexts with a hundredth of all symbols are states in memory; scores are those of
    all counted runs all the same, of texts that were not learned too."""
    monkeypatch.setattr(lmscore, "HEAD_ARCS", arcs)
    rng = np.random.default_rng(5)
    parts = ["ab", "tion", "th", "e", "qu", "on", "\u00e9", "z9", "str"]
    words = ["".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(60)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 25))) for _ in range(30)]
    texts += [None, "x" * 30, "the xylophone zzz \u4e00\u4e01 aba~", texts[3]]
    schema = "doc_id bigint, text string"
    train = spark.createDataFrame(list(enumerate(texts[:20])), schema)
    docs = spark.createDataFrame(list(enumerate(texts)), schema)
    model = lmscore.learn(train, least_share=1e-2)
    assert 64 ** 2 < model.automaton.states < 64 ** 2 + 300
    # at a count the arcs are all taken or none, so a small head may stay empty
    assert len(model.near[0]) <= arcs and (arcs < 1000 or len(model.near[0]) > 100)
    lists = [lmscore.split([(t or "").encode()])[0] for t in texts]
    runs = [lmscore.Stream([t], model.automaton.key).symbols.tolist() for t in lists]
    grams, context, kinds = Counter(), Counter(), Counter()
    for s in runs[:20]:
        for j in range(5, len(s)):
            grams.update(tuple(s[j - k:j + 1]) for k in range(6))
    for g, n in grams.items():
        context[g[:-1]] += n
        kinds[g[:-1]] += 1

    def p(history, symbol):
        if not history:
            return (grams[(symbol,)] + 0.5) / (context[()] + 0.5 * 64)
        low = p(history[1:], symbol)
        n, k = context[history], kinds[history]
        return (grams[(*history, symbol)] + k * low) / (n + k) if n else low

    counts = Counter(w for t in lists[:20] for w in [*t, b""])
    total = sum(counts.values())
    want = {}
    for i, (s, t) in enumerate(zip(runs, lists, strict=True)):
        want[i], j = 0.0, 5
        for w in [*t, b""]:
            own = 1.0
            for b in w + b" " if w else b"\0":
                own *= p(tuple(s[j - 5:j]), s[j]) * (10 ** model.automaton.inner[b] if s[j] == 63 else 1)
                j += 1
            want[i] += math.log10((1 - lmscore.WORD_WEIGHT) * own + lmscore.WORD_WEIGHT * counts[w] / total)
    got = {r["doc_id"]: r["score"] for r in lmscore.score(docs, model).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-5 * (1 + abs(want[i])) for i in want), (got, want)


def test_held_out_scores_beat_the_base(spark):
    got = run(spark, "op9_backoff_scores", "/root/testdata/sf0.1")
    assert got[got.held_out].score.sum() > got[got.held_out].base_score.sum()
    assert (got.score < 0).all()


# --- pipeline

def test_pipeline_against_its_operators(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = corpus_pipeline.run(spark, DIR).toPandas()
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = left.count()
        left = stage(spark, left, DIR)
        assert left.columns == docs.columns
        assert 0 < left.count() <= before, name
    kept = {r["doc_id"] for r in left.select("doc_id").collect()}
    assert set(got.doc_id) == kept
    # the plain version of the stages that have one
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    judged = corpus_pipeline.rules(spark, corpus_pipeline.language(spark, docs, DIR), DIR)
    texts = dict(texts_of(judged))
    unique = {c for _, _, c in plain_similar(list(texts.items()))}
    assert len(unique) < len(texts)
    assert kept == {i for i in unique if plain_hits(texts[i], items)[1] == 0}
    assert all(not plain_base(t)[5] for t in texts.values())


def test_pipeline_on_no_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DIR).count() == 0
