"""Each training-data operator against a brute-force version, with awkward rows."""
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reelframe.llm import bpe, embeddings, langid, neighbours, packing, quality, sharding, simhash, substrings, suffixes, windows
from reelframe.llm.common import components, sliding_argmin, window_hashes, written

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, salt string, h string, n long"  # extra columns with names that operators use


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def texts():
    base, passage = words(300, 1), words(60, 2)
    out = {
        0: " ".join(base), 1: None, 2: "", 3: " ".join(base), 4: " ".join(base[:150] + ["changed"] + base[151:]), 5: " ".join(words(40, 3) + passage + words(40, 4)),
        6: "\n".join(words(30, 5) + passage + words(9, 6)), 7: "a b " * 60, 8: " ".join(words(9000, 7)), 9: "Hello WORLD, it's 42 <|endoftext|> naïve Σς ﬁ \x1c end", 10: "x", 11: "\t \n",
        12: "q" * 3000, 13: " ".join(passage[5:27]), 14: " ".join(words(10, 8) + passage[:30]), 15: "İstanbul ǅ é 日本語 कखग", 16: "two words",
    }
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", "h", 1) for i, t in texts().items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def collected(df, key=0):
    return {r[key]: r for r in df.collect()}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_bpe_equals_the_library(spark, docs):
    tk = Tokenizer.from_file(PATH)
    got, back = collected(bpe.encode(docs, PATH)), collected(bpe.decode(bpe.encode(docs, PATH), PATH))
    sums = collected(bpe.digests(docs, PATH))
    for i, t in texts().items():
        ids = tk.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids
        assert back[i]["text"] == tk.decode(ids, skip_special_tokens=False)
        assert sums[i]["ids_sha256"] == sha(" ".join(map(str, ids))) and sums[i]["decoded_sha256"] == sha(back[i]["text"])
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_bpe_forgets_and_learns_again():
    tk, own = Tokenizer.from_file(PATH), bpe.WordBpe(PATH, memory=5)
    for i in range(30):
        t = " ".join(words(20, i, 50)) + " <|startoftext|>" + "z" * i
        assert own.encode(t) == tk.encode(t, add_special_tokens=False).ids


def test_packing(spark, docs):
    tk = Tokenizer.from_file(PATH)
    out = packing.pack_documents(docs.unionByName(docs.where("doc_id = 10")), PATH, 64, 1).collect()
    lengths = collections.Counter()
    for r in out:
        assert 0 < r["length"] <= 64
        lengths[r["doc_id"]] += r["length"]
    for i, t in texts().items():
        assert lengths[i] == (len(tk.encode(t or "", add_special_tokens=False).ids) + 1) * (2 if i == 10 else 1)
    by = collections.defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 64
    assert len(by) == -(-sum(r["length"] for r in out) // 64) or len(by) <= 1.02 * sum(r["length"] for r in out) / 64 + 1
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_packed_pieces_are_the_library_s_ids(docs):
    tk = Tokenizer.from_file(PATH)
    for r in packing.pack_documents(docs, PATH, 64, 1).collect():
        ids = tk.encode(texts()[r["doc_id"]] or "", add_special_tokens=False).ids + [1]
        part = ids[64 * r["piece"] : 64 * r["piece"] + 64]
        assert (r["start"], r["length"], r["ids_crc32"]) == (64 * r["piece"], len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()))


@pytest.mark.parametrize("kind", ["mixed", "one length holds a third", "nothing fits together"])
def test_packing_comes_near_best_fit_decreasing(spark, kind):
    r = random.Random(7)
    some = {"mixed": lambda: r.randint(1, 50), "one length holds a third": lambda: r.choice([7, r.randint(8, 50), r.randint(3, 20)]), "nothing fits together": lambda: r.randint(26, 50)}[kind]
    sizes = [some() for _ in range(400)]
    gaps: list[int] = []
    for s in sorted(sizes, reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        gaps.append((50 if fit is None else gaps.pop(gaps.index(fit))) - s)
    rows = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, length long")
    by = collections.defaultdict(list)
    for x in packing.pack(rows, 50, ["doc_id"]).collect():
        by[x["sequence_id"]].append((x["offset"], x["length"]))
    assert sorted(n for spans in by.values() for _, n in spans) == sorted(sizes)
    for spans in by.values():
        spans.sort()
        assert [at for at, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 50
    assert len(by) <= 1.02 * len(gaps) + 1


def brute_prints(width):
    out = {}
    for i, t in texts().items():
        found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = [" ".join(found[k : k + width]) for k in range(len(found) - width + 1)] if len(found) >= width else ([" ".join(found)] if found else [])
        h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
        out[i] = sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))
    return out


def grouped(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(docs):
    want = brute_prints(3)
    comp = grouped(want, [(a, b) for a in want for b in want if a < b and bin(want[a] ^ want[b]).count("1") <= 2])
    got = collected(simhash.near_duplicates(docs))
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{want[i]:016x}", comp[i]) for i in want}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_covering_links_are_exact_even_for_crowded_keys(spark):
    r = random.Random(5)
    centre = r.getrandbits(64)
    prints = {centre} | {centre ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(300)} | {r.getrandbits(64) for _ in range(200)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {x["node"]: x["component"] for x in components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fingerprint long"))).collect()}
    want = grouped(signed, [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2])
    assert {p: got.get(p, p) for p in signed} == want


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(50), r.randrange(50)) for _ in range(40)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = grouped({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if k in got} and all(k in got for e in edges if e[0] != e[1] for k in e)


def brute_windows(size):
    seen, out = set(), {}
    for i, t in sorted(texts().items()):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if key in seen:
                gone[k : k + size] = [True] * size
            seen.add(key)
        out[i] = (" ".join(x for x, g in zip(w, gone) if not g), len(w), sum(gone))
    return out


@pytest.mark.parametrize("module, size", [(substrings, 20), (suffixes, 50), (suffixes, 20)])
def test_repeated_windows(docs, module, size):
    want = brute_windows(size)
    got = collected(module.deduplicate(docs, size))
    assert {i: (r["kept"], r["n_words"], r["n_removed"]) for i, r in got.items()} == want
    assert sum(w[2] > 0 for w in want.values()) >= 3
    assert module.deduplicate(docs.limit(0), size).count() == 0


def test_index_finds_repeats_across_batches_and_compacts(spark):
    index, seen = substrings.FingerprintIndex(spark, buckets=3), set()
    r = random.Random(9)
    for _ in range(6):
        batch = [r.randrange(2000) for _ in range(150)]
        want = {h for h in batch if h in seen or batch.count(h) > 1}
        got = {x["h"] for x in index.add(spark.createDataFrame([(h,) for h in batch], "h long")).collect()}
        assert got == want and len(index.runs) < substrings.FAN_IN
        seen |= set(batch)
    assert substrings.FingerprintIndex(spark, index.name).runs == index.runs
    index.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(index.name)]


def test_a_later_call_deduplicates_against_an_index_of_an_earlier_one(spark, docs):
    want, name = brute_windows(20), "fingerprints_kept"
    old, new = docs.where("doc_id < 7"), docs.where("doc_id >= 7")
    got = collected(substrings.deduplicate(old, 20, index=substrings.FingerprintIndex(spark, name)))
    index = substrings.FingerprintIndex(spark, name)
    assert index.runs and index.entries
    got |= collected(substrings.deduplicate(new, 20, index=index, history=old))
    index.drop()
    assert {i: (r["kept"], r["n_words"], r["n_removed"]) for i, r in got.items()} == want
    assert any(want[i][2] for i in want if i >= 7)


def test_runs_are_compacted_with_runs_of_like_size(spark):
    index = substrings.FingerprintIndex(spark, buckets=2)
    hashes = lambda low, n: spark.range(low, low + n).selectExpr("id as h")
    index.add(hashes(0, 5000))
    large = index.runs[0]
    for k in range(5):
        index.add(hashes(10_000 + 20 * k, 20))
    assert large in index.runs and sorted(index.rows.values()) == [20, 80, 5000]
    assert [r["h"] for r in index.add(hashes(4999, 2)).collect()] == [4999]
    index.drop()


def test_a_failed_call_leaves_the_index_and_a_repeated_one_gives_the_same(spark, docs, monkeypatch):
    want, name = brute_windows(20), "fingerprints_atomic"
    old, new = docs.where("doc_id < 7"), docs.where("doc_id >= 7")
    substrings.deduplicate(old, 20, index=substrings.FingerprintIndex(spark, name))
    before = substrings.FingerprintIndex(spark, name).rows

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(substrings.FingerprintIndex, "keep", fails)
        with pytest.raises(OSError):
            substrings.deduplicate(new, 20, index=substrings.FingerprintIndex(spark, name), history=old)
    assert substrings.FingerprintIndex(spark, name).rows == before
    for _ in range(2):
        got = collected(substrings.deduplicate(new, 20, index=substrings.FingerprintIndex(spark, name), history=old))
        assert {i: (r["kept"], r["n_words"], r["n_removed"]) for i, r in got.items()} == {i: w for i, w in want.items() if i >= 7}
    index = substrings.FingerprintIndex(spark, name)
    assert set(index.found()) == {*index.rows, *[t for t in index.found() if "_manifest_" in t]} and sum("_manifest_" in t for t in index.found()) == 1
    index.drop()
    assert not index.found()


def test_of_history_only_met_texts_move(spark):
    history = spark.createDataFrame([(i, "x") for i in range(5000)], "doc_id long, text string")
    met = windows.met_by(spark.createDataFrame([(3,), (4000,)], "doc_id long"), history)
    assert {3, 4000} <= {r["doc_id"] for r in met.collect()} and met.count() < 20 and met.columns == ["doc_id", "text"]


def test_suffixes_meet_in_crowded_groups_and_over_blocks(spark, monkeypatch):
    r = random.Random(3)
    word = lambda: f"w{r.randrange(10**6)}"
    passages = [[word() for _ in range(30)] for _ in range(4)]
    rows = []
    for i in range(120):
        p = list(passages[i % 4])
        if i % 7 == 0:
            p[r.randrange(30)] = word()
        rows.append((i, " ".join([word() for _ in range(r.randrange(25))] + p[: 30 - i % 5] + [word() for _ in range(r.randrange(25))]), 1))
    r.shuffle(rows)
    seen, want = set(), {}
    for i, t, _ in sorted(rows):
        w, gone = t.split(), set()
        for k in range(len(w) - 19):
            if tuple(w[k : k + 20]) in seen:
                gone.update(range(k, k + 20))
            seen.add(tuple(w[k : k + 20]))
        want[i] = len(gone)
    df = spark.createDataFrame(rows, "doc_id long, text string, place int").repartition(3)
    for block in (4096, 5):
        monkeypatch.setattr(suffixes, "BLOCK", block)
        assert {i: x["n_removed"] for i, x in collected(suffixes.deduplicate(df, 20)).items()} == want
    assert sum(n > 0 for n in want.values()) > 80


def test_windows_wider_than_their_packing_are_refused(docs):
    with pytest.raises(ValueError):
        substrings.deduplicate(docs, 263)


def test_window_hashes_and_argmin():
    x = np.random.default_rng(1).integers(0, 9, 300).astype(np.uint64)
    for size in (1, 2, 3, 5, 20, 50):
        h = window_hashes(x, size, 3)
        tuples = [tuple(x[i : i + size]) for i in range(len(x) - size + 1)]
        assert len(h) == len(tuples) and len(set(h.tolist())) == len(set(tuples))
        assert sliding_argmin(x, size).tolist() == [i + int(np.argmin(x[i : i + size])) for i in range(len(x) - size + 1)]


def vectors(spark, n=400, width=16, seed=2):
    r = np.random.default_rng(seed)
    v = r.standard_normal((n, width)).astype(np.float32)
    for i in range(0, n, 4):
        v[i + 1] = v[i] + 0.05 * r.standard_normal(width)
    v[10] = v[50] = v[90]
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(n, None), (n + 1, [0.0] * width), (n + 2, [float("nan")] * width), (n + 3, [None] * width), (n + 4, [float("inf")] * width)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), v.astype(np.float64)


def test_embedding_links(spark):
    df, v = vectors(spark)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    got = collected(embeddings.near_duplicates(df, 0.9))
    want = grouped(range(len(v)), [(int(a), int(b)) for a, b in zip(*np.nonzero(close)) if a < b])
    found = sum(min(got[i]["n_links"], int(close[i].sum())) for i in range(len(v)))
    assert found >= 0.9 * close.sum() and all(got[i]["n_links"] <= close[i].sum() for i in range(len(v)))
    assert np.mean([got[i]["component_id"] == want[i] for i in range(len(v))]) > 0.95
    assert all(got[len(v) + k]["n_links"] == 0 and got[len(v) + k]["kept"] for k in range(5))
    assert embeddings.near_duplicates(df.limit(0)).count() == 0 and embeddings.near_duplicates(df.where("vec_id >= 400")).count() == 5


def test_neighbours(spark):
    df, v = vectors(spark)
    got = collections.defaultdict(list)
    for r in neighbours.search(df, df.where("vec_id % 20 = 0"), 10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    recall = []
    for q in range(0, len(v), 20):
        s = v @ v[q]
        want = [i for i in np.lexsort((np.arange(len(v)), -s)) if i != q][:10]
        recall.append(len({i for i, _ in got[q]} & set(want)) / 10)
        assert [s_ for _, s_ in got[q]] == sorted((s_ for _, s_ in got[q]), reverse=True) and all(abs(s_ - s[i]) < 1e-9 for i, s_ in got[q])
    assert np.mean(recall) >= 0.9 and len(got) == 20
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0
    assert neighbours.search(df.where("vec_id < 3"), df.where("vec_id < 1"), 10).count() == 2


def test_hashing_prunes_where_vectors_have_near_neighbours(spark):
    r = np.random.default_rng(4)
    centres = r.standard_normal((60, 32))
    v = centres[r.integers(0, 60, 1500)] + 0.15 * r.standard_normal((1500, 32))
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(i, row.tolist(), 1) for i, row in enumerate(v)], "vec_id long, embedding array<double>, rep long")  # a column with a name that the operator uses
    ask = df.where("vec_id % 50 = 0")
    assert neighbours.share_met(df, ask, 10, tables=8, hashes=10, visits=8) < 0.1
    got = collections.defaultdict(set)
    for x in neighbours.search(df, ask, 10, tables=8, hashes=10, visits=8).collect():
        got[x["query_id"]].add(x["vec_id"])
    s = v[::50] @ v.T
    s[np.arange(30), np.arange(0, 1500, 50)] = -9
    assert np.mean([len(got[50 * i] & set(np.argsort(-row)[:10].tolist())) / 10 for i, row in enumerate(s)]) >= 0.9


def test_vectors_of_unequal_length_and_ties(spark):
    rows = [(1, [1.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0]), (5, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(x["rank"], x["vec_id"], x["score"]) for x in neighbours.search(df, df.where("vec_id = 1"), 4).orderBy("rank").collect()]
    assert got[:3] == [(1, 2, 1.0), (2, 4, 1.0), (3, 5, 1.0)]


def best_capacity(sizes, k):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, n, t = (low + high) // 2, 1, 0
        for s in sizes:
            n, t = (n + 1, s) if t + s > mid else (n, t + s)
        low, high = (low, mid) if n <= k else (mid + 1, high)
    return low


def test_sharding(spark, docs):
    many = docs.unionByName(docs.where("doc_id = 16").withColumn("doc_id", F.explode(F.sequence(F.lit(100).cast("long"), F.lit(400).cast("long")))))
    rows = sharding.shard_by_bytes(many, 5).collect()
    text = texts()
    shards, groups, total = collections.defaultdict(list), collections.defaultdict(set), collections.Counter()
    for r in rows:
        t = text[r["doc_id"]] if r["doc_id"] < 100 else text[16]
        assert r["size"] == len((t or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((t or "").encode())
        shards[r["shard"]].append(r["slot"])
        groups[t].add(r["shard"])
        total[r["shard"]] += r["size"]
    assert len(rows) == len(text) + 301 and all(len(g) == 1 for g in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert sharding.shard_by_bytes(docs.limit(0)).count() == 0


@pytest.mark.parametrize("cells", [64, 1 << 16])
def test_capacity_is_minimal(spark, monkeypatch, cells):
    monkeypatch.setattr(sharding, "CELLS", cells)
    r = random.Random(cells)
    sizes = [r.randint(8, 4000) for _ in range(500)] + [90_000] + [r.randint(8, 100) for _ in range(500)]
    ends = np.cumsum(sizes).tolist()
    df = written(spark.createDataFrame(list(zip(ends, sizes)), "end long, bytes long"), "ends")
    bounds = sharding.Boundaries(df)
    limit = sharding.capacity(bounds, 7)
    assert limit == best_capacity(sizes, 7)
    at = [0, *sharding.cuts(bounds, limit, 7), ends[-1]]
    assert all(a <= b for a, b in zip(at, at[1:])) and max(b - a for a, b in zip(at, at[1:])) <= limit and set(at[1:]) <= set(ends)


LANGUAGES = {"aa": ["tion", "the", "ing", "and"], "bb": ["ción", "que", "los", "ñar"], "cc": ["ung", "keit", "sch", "ß"]}


def spoken(lang, n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(LANGUAGES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_language(spark):
    rows = [(i, spoken(lang, 30, i), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 40)] + [(500, None, None), (501, "123 !!", "aa"), (502, "", None), (503, spoken("bb", 10, 99), None), (504, "zzzz", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = collected(langid.identify(df))
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:120]) and got[503]["lang_pred"] == "bb"
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert [got[i]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3 and got[504]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.identify(df.where("lang is null")).collect()} == {"und"}


def letter_trigrams(text):
    letters = [c if c.isalpha() else "" for c in text.lower()]
    padded = ["", *letters, ""]
    return [(padded[i], padded[i + 1], padded[i + 2]) for i in range(len(padded) - 2) if padded[i + 1]]


def test_language_filter_decides_as_exact_sets_do(spark):
    rows = [(i, spoken(lang, 25, i), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 15)] + [(200 + i, spoken("aa", 6, i) + " " + spoken("cc", 9, i), None) for i in range(10)] + [(300, "Σς ÄÖ 12", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = collections.defaultdict(collections.Counter)
    for i, text, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 5:
            counts[lang].update(letter_trigrams(text))
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    share = {lang: {g: n / total[lang] for g, n in c.items() if n / total[lang] >= langid.LEAST} for lang, c in counts.items()}
    most = collections.defaultdict(float)
    for s in share.values():
        for g, x in s.items():
            most[g] = max(most[g], x)
    sets = {lang: {g for g, x in s.items() if x >= langid.RATIO * most[g]} for lang, s in share.items()}
    order = sorted(total, key=lambda x: (-total[x], x))
    got = collected(langid.identify(df))
    for i, text, _ in rows:
        grams = letter_trigrams(text)
        known = [sum(g in sets[lang] for g in grams) / len(grams) for lang in order]
        best = max(range(len(order)), key=lambda k: (known[k], -k))
        assert got[i]["score"] == pytest.approx(known[best], abs=0.01)
        assert got[i]["lang_pred"] == order[best]


def test_quality(spark):
    rows = [(i, spoken("aa", 40, i), "aa") for i in range(60)] + [(100 + i, "## " + "QX!! %% " * 20, "aa") for i in range(5)] + [(200, None, "aa"), (201, spoken("aa", 40, 777), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    got = collected(quality.classify(df, trusted))
    assert all(got[i]["kept"] for i in range(60)) and not any(got[100 + i]["kept"] for i in range(5)) and not got[200]["kept"] and got[201]["kept"]
    assert quality.classify(df.limit(0), trusted).count() == 0 and quality.classify(df, trusted.limit(0)).where("kept").count() == 66
    judges = sorted(got[i]["perplexity"] for i in range(50) if zlib.crc32(str(i).encode()) % quality.HELD_OUT == 0)
    limit = judges[max(0, int(np.ceil(quality.QUANTILE * len(judges))) - 1)] * quality.SLACK
    assert all(r["threshold"] == pytest.approx(limit) for r in got.values())
    assert all(r["kept"] == (r["perplexity"] is not None and r["perplexity"] <= limit) for r in got.values())


def word_kneser_ney(texts, order):
    """Probability of a word after its context, by the definition, over plain tuples."""
    from collections import Counter, defaultdict

    tops = Counter(g for t in texts for g in word_tuples(t, order))
    counts = {order: tops}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    symbols, cuts, contexts = len(counts[1]) + 1, {}, {}
    for k, c in counts.items():
        t1, t2, t3, t4 = (sum(1 for n in c.values() if n == i) for i in (1, 2, 3, 4))
        y = t1 / (t1 + 2 * t2) if t1 + 2 * t2 else 0.0
        raw = [1 - 2 * y * t2 / t1 if t1 else 0.5, 2 - 3 * y * t3 / t2 if t2 else 1.0, 3 - 4 * y * t4 / t3 if t3 else 1.5]
        cuts[k] = [min(max(d, 0.05), i - 0.05) for d, i in zip(raw, (1, 2, 3))]
        contexts[k] = defaultdict(lambda: [0, 0.0])
        for g, n in c.items():
            contexts[k][g[:-1]][0] += n
            contexts[k][g[:-1]][1] += cuts[k][min(n, 3) - 1]

    def p(g):
        if not g:
            return 1 / symbols
        k = len(g)
        if g[:-1] not in contexts[k]:
            return p(g[1:])
        total, cut = contexts[k][g[:-1]]
        n = counts[k][g]
        return (n - (cuts[k][min(n, 3) - 1] if n else 0)) / total + cut / total * p(g[1:])

    return p


def word_tuples(text, order):
    words = ["^"] * (order - 1) + text.split()
    return [tuple(words[i : i + order]) for i in range(len(words) - order + 1)]


def test_classify_scores_words(spark):
    corpus = [spoken("aa", 30, i) for i in range(14)]
    rows = [(i, t, "aa") for i, t in enumerate(corpus)] + [(20, "never seen here", "bb"), (21, None, None), (22, " ", "aa"), (23, corpus[0] + " zzz " + corpus[1], "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(10)], "doc_id long")
    held = {r[0] for r in trusted.where("crc32(cast(doc_id as string)) % 5 = 0").collect()}
    assert 0 < len(held) < 10
    p = word_kneser_ney([t for i, t in enumerate(corpus) if i < 10 and i not in held], quality.ORDER)
    got = collected(quality.classify(df, trusted))
    for i, t, _ in rows:
        grams = word_tuples(t or "", quality.ORDER)
        want = float(np.exp(-sum(np.log(p(g)) for g in grams) / len(" ".join(t.split()).encode()))) if grams else None
        assert got[i]["perplexity"] == (want if want is None else pytest.approx(want, rel=1e-6))


def test_classify_writes_no_whole_ngrams(spark, monkeypatch):
    corpus = [spoken("aa", 30, i) for i in range(12)]
    df = spark.createDataFrame([(i, t, "aa") for i, t in enumerate(corpus)], "doc_id long, text string, lang string")
    trusted, longest, write = spark.createDataFrame([(i,) for i in range(10)], "doc_id long"), [], quality.written

    def watched(rows, name):
        out = write(rows, name)
        if "g" in out.columns:
            longest.append(out.selectExpr("max(octet_length(g)) n").first()["n"] or 0)
        return out

    monkeypatch.setattr(quality, "written", watched)
    monkeypatch.setattr(quality, "KNOWN", 4)  # the other shared n-grams are joined
    got = collected(quality.classify(df, trusted))
    assert longest and max(longest) < 8 * quality.ORDER
    p = word_kneser_ney([t for i, t in enumerate(corpus) if i < 10 and zlib.crc32(str(i).encode()) % quality.HELD_OUT], quality.ORDER)
    for i, t in enumerate(corpus):
        want = float(np.exp(-sum(np.log(p(g)) for g in word_tuples(t, quality.ORDER)) / len(" ".join(t.split()).encode())))
        assert got[i]["perplexity"] == pytest.approx(want, rel=1e-6)


LINK_SCHEMA = "vec_id long, embedding array<double>, rep long, component string, first int"


def brute_links(rows, threshold):
    width = max((len(v) for _, v, *_ in rows if v is not None), default=0)
    ok = [i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, *_ in rows]
    unit = [np.array(list(v) + [0.0] * (width - len(v))) / np.linalg.norm(v) if good else None for (_, v, *_), good in zip(rows, ok)]
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if ok[a] and ok[b] and unit[a] @ unit[b] >= threshold]
    degree = collections.Counter(x for pair in linked for x in pair)
    root = grouped(range(len(rows)), linked)
    members = collections.defaultdict(list)
    for i in range(len(rows)):
        members[root[i]].append(i)
    out = []
    for i, (vec, *_) in enumerate(rows):
        least = min((rows[j][0] for j in members[root[i]] if rows[j][0] is not None), default=None)
        out.append((vec, degree[i], least, vec == least))
    return sorted(out, key=str)


def test_embedding_links_of_every_kind_over_several_lists(spark, monkeypatch):
    """Copies, chains, pairs near the threshold, repeated ids on equal and on different vectors, unequal lengths, unusable rows."""
    monkeypatch.setattr(embeddings, "SAMPLE", 200, raising=False)
    r, rows = np.random.default_rng(5), []
    centres = r.normal(size=(40, 12))
    for k, c in enumerate(centres):
        for j in range(8):
            rows.append((10 * k + j, (c / np.linalg.norm(c) + r.normal(size=12) * 0.08 * (j % 4)).tolist()))
    chain = [[float(np.cos(0.3 * t)), float(np.sin(0.3 * t))] for t in range(6)]
    rows += [(5000 + t, v) for t, v in enumerate(chain)] + [(6000, chain[0]), (6000, chain[0]), (5001, chain[5]), (7, [9.0]), (3, None), (3, [0.0] * 12), (8, [float("nan")] * 12), (None, [1.0] * 12), (9, [])]
    full = [(i, v, 0, "x", 1) for i, v in rows]
    got = embeddings.near_duplicates(spark.createDataFrame(full, LINK_SCHEMA).repartition(5), 0.9).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"], bool(r["kept"])) for r in got), key=str) == brute_links(full, 0.9)


def test_a_null_vector_does_not_hide_behind_its_id(spark):
    rows = [(1, [1.0, 0.0], 0, "", 0), (1, None, 0, "", 0), (2, [1.0, 0.0], 0, "", 0)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, LINK_SCHEMA), 0.9).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False)]


def test_neighbours_take_the_least_of_vectors_that_share_an_id(spark):
    rows = [(0, [1.0, 0.0], 0, "", 0), (1, [5.0, 0.0], 0, "", 0), (1, [2.0, 9.0], 0, "", 0), (2, [3.0, 0.0], 0, "", 0)]
    d = spark.createDataFrame(rows, LINK_SCHEMA)
    for n in (1, 4):
        got = neighbours.search(d.repartition(n), d.where("vec_id = 0"), n=5).collect()
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 2, 3.0), (2, 1, 2.0)]
