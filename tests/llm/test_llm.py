"""Each operator against a brute-force version, an exact round trip or held-out accuracy, on a corpus of odd rows."""

import base64
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import bpe_replay, decontaminate, embed_dedup, html_extract, line_dedup, minhash_dedup, quality_crf, sst_output, suffix_dedup, token_rollup

VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")
LOW = {i: i + 32 for i in range(65, 91)}


class Groups(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def by_id(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select(*columns).collect()}


# 9 ------------------------------------------------------------------------------------------------


def test_ids_equal_the_library(spark, rows, docs, no_docs):
    import tiktoken

    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe_replay.digests(docs, VOCABULARY, P.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    for i, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert bpe_replay.digests(no_docs, VOCABULARY, P.PATTERN).count() == 0
    clash = docs.withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("x")).withColumn("a.b", F.lit(2))
    back = bpe_replay.encode_and_decode(clash, VOCABULARY, P.PATTERN)
    assert back.columns == [*docs.columns, "a.b", "n_tokens", "ids"]
    assert by_id(back, "doc_id", "text") == {r[0]: (r[1],) for r in rows}
    encoded = bpe_replay.encode_documents(docs, VOCABULARY, P.PATTERN)
    assert by_id(bpe_replay.decode_documents(encoded, VOCABULARY, P.PATTERN), "doc_id", "text") == {r[0]: (r[1] or "",) for r in rows}


def test_white_space_of_all_kinds():
    import tiktoken

    bpe = bpe_replay.MergeReplay(VOCABULARY, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(" \n\t  \x1c\x85ab1'=s,é") for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    for t, ids in zip(texts, bpe.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t), repr(t)


# 7 ------------------------------------------------------------------------------------------------


def test_shards_round_trip(spark, rows, docs, no_docs, tmp_path):
    from pyarrow import fs
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    shards = sst_output.write_shards(docs, P.path("byte_bpe_50k.json"), 2, f"file://{tmp_path}/sst")
    got = by_id(sst_output.read_shards(shards), "doc_id", "start", "n_tokens", "ids_crc32")
    start, want = 0, {}
    for i, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        want[i] = model.encode(text or "", add_special_tokens=False).ids + [2]
        assert got[i] == (start, len(want[i]), zlib.crc32(np.array(want[i], "<u4").tobytes())), i
        start += len(want[i])
    for s in shards.collect():
        place, path = fs.FileSystem.from_uri(s["shard"])
        with place.open_input_file(path) as f:
            table = sst_output.Table(f)
            here = [sst_output.id_of(k) for k, _ in table.scan()]
            for i in [*here, 987654321, None]:
                found = [np.frombuffer(x, "<u4").tolist() for x in table.get(i)]
                assert found == ([want[i]] if i in here else [])
    assert sst_output.read_shards(sst_output.write_shards(no_docs, P.path("byte_bpe_50k.json"), 2, f"file://{tmp_path}/none")).count() == 0
    twice = docs.where("doc_id = 1").union(docs.where("doc_id = 1"))
    assert sst_output.read_shards(sst_output.write_shards(twice, P.path("byte_bpe_50k.json"), 2, f"file://{tmp_path}/two")).count() == 2


def test_many_entries_and_wide_ids(tmp_path):
    from pyarrow import fs

    path = str(tmp_path / "x.sst")
    place = fs.LocalFileSystem()
    entries = [(i * 7 - 500, np.array([i, 70000 if i % 3 == 0 else 5] * (i % 40), "<u4").tobytes()) for i in range(4000)]
    with place.open_output_stream(path) as out:
        w = sst_output.Writer(out)
        for i, ids in entries:
            w.add(sst_output.key_of(i), ids)
        w.close()
    with place.open_input_file(path) as f:
        t = sst_output.Table(f)
        assert len(t.where) > 1 and t.entries == 4000
        assert [(sst_output.id_of(k), v) for k, v in t.scan()] == entries
        assert all(t.get(i) == [ids] for i, ids in entries[::97]) and t.get(-499) == []


# 10 -----------------------------------------------------------------------------------------------


def words10(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute10(rows, items, width=10):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words10(t)
        for k in range(len(w) - min(width, len(w)) + 1) if w else ():
            windows[tuple(w[k : k + width])].add(i)
    out = {}
    for d, t, *_ in rows:
        w, hit, found = words10(t), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit.update(range(k, k + m))
                    found |= windows[tuple(w[k : k + m])]
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out


def test_contamination(spark, rows, docs, no_docs, monkeypatch):
    rnd = random.Random(2)
    full = [r for r in rows if r[1] and len(r[1].split()) > 12]
    items = [(n, " ".join(rnd.choice(full)[1].upper().split()[k : k + size])) for n, (k, size) in enumerate([(0, 12), (3, 30), (1, 4), (2, 1), (0, 10), (5, 25)] * 3)]
    items += [(50, None), (51, ""), (52, "..."), (53, "nothing like it is here at all or is it so"), (54, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    want = brute10(rows, items)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert by_id(decontaminate.digests(docs, bench), *columns) == want
    monkeypatch.setattr(decontaminate.bench_blocks, "__defaults__", (200,))  # several blocks
    assert by_id(decontaminate.digests(docs, bench), *columns) == want
    none = spark.createDataFrame([], "item_id long, text string")
    assert {v[1] for v in by_id(decontaminate.digests(docs, none), *columns).values()} == {0}
    assert decontaminate.digests(no_docs, bench).count() == 0
    clash = docs.withColumn("hits", F.lit(3)).withColumn("row", F.lit(4))
    clean = decontaminate.remove(clash, bench)
    assert clean.columns == clash.columns
    got = by_id(clean, "doc_id", "text")
    for i, text, *_ in rows:
        assert got[i][0] == text if not want[i][4] else len(got[i][0]) < len(text)


def test_suffix_array_and_wavelet():
    rnd = np.random.default_rng(1)
    for n, alphabet in ((1, 3), (50, 4), (700, 30)):
        seq = rnd.integers(1, alphabet, n)
        index = decontaminate.FMIndex(seq, alphabet)
        whole = list(seq) + [0]
        for m in (1, 2, 5):
            patterns = np.array([seq[k : k + m] for k in range(0, max(1, n - m), 3) if k + m <= n] or [[alphabet - 1] * m])
            lo, hi = index.search(patterns)
            for p, a, b in zip(patterns, lo, hi, strict=True):
                want = [k for k in range(n) if whole[k : k + m] == list(p)]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# 6 ------------------------------------------------------------------------------------------------


def shingles6(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute6(rows):
    sets = {d: shingles6(t) for d, t, *_ in rows}
    groups = Groups()
    for a, b in itertools.combinations([d for d in sets if d is not None], 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            groups.join(a, b)
    return {d: (len(s), None if d is None else groups.find(d), d is None or groups.find(d) == d) for d, s in sets.items()}


@pytest.mark.parametrize("small", [2, 16])
def test_near_documents(docs, rows, no_docs, small):
    got = by_id(minhash_dedup.near_duplicates(docs.withColumn("class", F.lit(1)).withColumn("id", F.lit(2)), small=small), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute6(rows)
    assert sum(not v[2] for v in got.values()) > 5
    if small == 2:
        assert minhash_dedup.near_duplicates(no_docs).count() == 0


def test_large_bucket_of_several_groups(spark):
    """Two bases that differ in a fifth, each with many variants: stars alone would leave some apart."""
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for n in range(80):
        w = list(base)
        for k in rnd.sample(range(120), rnd.randint(0, 4)):
            w[k] = f"x{n}_{k}"
        rows.append((n, " ".join(w), "en", "s", 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert by_id(minhash_dedup.near_duplicates(df, small=3, part=20, block=16), "doc_id", "n_shingles", "component_id", "kept") == brute6(rows)


@pytest.mark.parametrize("part, block", [(128, 512), (12, 7)])
def test_chains_within_large_buckets(spark, part, block):
    """Texts a step apart are linked, others are not, and several chains share their words."""
    rows = []
    for chain in range(4):
        base = [f"w{i}" if i % 10 < 7 else f"w{i}c{chain}" for i in range(100)]
        for n in range(30):
            rows.append((chain * 100 + n, " ".join(f"y{chain}-{n - n % 3}-{i}" if (i + n) % 100 < 3 * (n % 3) else x for i, x in enumerate(base))))
    rows += [(1000 + n, " ".join(f"q{(n * 7 + i) // 3}" for i in range(40))) for n in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(minhash_dedup.near_duplicates(df, small=3, part=part, block=block), "doc_id", "n_shingles", "component_id", "kept") == brute6(rows)


def test_repeated_identifiers_are_one_vertex(spark):
    say = lambda w: " ".join(f"{w}{i}" for i in range(30))
    rows = [(1, say("a")), (1, say("b")), (2, say("a") + " x"), (3, say("b") + " x"), (4, say("b") + " x"), (5, say("c")), (5, say("c")), (6, ""), (None, say("a"))]
    for order in (rows, rows[::-1]):
        got = minhash_dedup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 6), (None, None)}
        assert len(got) == len(rows)


def test_recall_of_pairs_near_the_threshold(spark):
    """Of 2,000 pairs at similarities of 0.75 to 0.80, at least 0.998 are linked."""
    rnd, rows = random.Random(11), []
    for n in range(2000):
        size, tail = 400, rnd.randint(45, 55)
        words = [f"{n}-{i}" for i in range(size)]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(words[: size - tail] + [f"{n}+{i}" for i in range(tail)]))]
    got = by_id(minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "component_id")
    alike = [n for n in range(2000) if 100 * (k := len((x := shingles6(rows[2 * n][1])) & (y := shingles6(rows[2 * n + 1][1])))) >= 75 * len(x | y) and k]
    found = sum(got[2 * n + 1][0] == 2 * n for n in alike)
    assert len(alike) > 1000 and found >= 0.998 * len(alike)
    assert sum(got[2 * n + 1][0] == 2 * n for n in range(2000)) == found


def test_signature_is_circulant():
    x = np.random.default_rng(0).integers(0, 2**63, 500).astype(np.uint64)
    y = np.concatenate([x[:400], np.random.default_rng(1).integers(0, 2**63, 100).astype(np.uint64)])
    same = (minhash_dedup.signature(x, 2000) == minhash_dedup.signature(y, 2000)).mean()
    assert abs(same - 400 / 600) < 0.05
    once = minhash_dedup.permute32(np.arange(1 << 16, dtype=np.uint32), 0x9E3779B1, 0x27D4EB2F)
    assert len(set(once.tolist())) == 1 << 16


# 5 ------------------------------------------------------------------------------------------------


def brute5(rows, length=100):
    seen, out = set(), {}
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, int)
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p] += 1
                gone[p + length] -= 1
            seen.add(s)
        mask = np.cumsum(gone)[: len(raw)] > 0
        kept = bytes(np.frombuffer(raw, np.uint8)[~mask]) if raw else b""
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], mask.astype(int)])) == 1))
        out[d] = (len(raw), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_strings(docs, rows, no_docs):
    got = by_id(suffix_dedup.digests(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute5(rows)
    assert sum(v[1] for v in got.values()) > 1000
    assert suffix_dedup.digests(no_docs).count() == 0


@pytest.mark.parametrize("share", [1000, 10**9])
def test_repeated_strings_with_shifted_overlaps(spark, monkeypatch, share):
    monkeypatch.setattr(suffix_dedup, "HOT_SHARE", share)  # at worst every repeated hash is salted
    rnd = random.Random(7)
    base = "".join(rnd.choice("abc ") for _ in range(900))
    rows = []
    for n in range(60):
        a = rnd.randrange(700)
        cut = base[a : a + rnd.randint(90, 200)]
        rows.append((n, "".join(rnd.choice("def") for _ in range(rnd.randint(0, 40))) + cut + rnd.choice(["", "z" * 5, cut[:120]]), "en", "s", 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    assert by_id(suffix_dedup.digests(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute5(rows)


def test_column_sort_equals_sorted_suffixes():
    rnd = random.Random(1)
    for _ in range(100):
        parts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 12))) for _ in range(rnd.randint(1, 8))]
        bwt, lcp = suffix_dedup.column_sort(parts)
        suffixes = sorted(([b + 1 for b in p[k:]] + [-1000 + i], i, k) for i, p in enumerate(parts) for k in range(len(p) + 1))
        assert bwt.tolist() == [parts[i][k - 1] + 1 if k else 0 for _, i, k in suffixes]
        common = [0]
        for (a, _, _), (b, _, _) in itertools.pairwise(suffixes):
            n = 0
            while n < min(len(a), len(b)) - 1 and a[n] == b[n]:
                n += 1
            common.append(n)
        assert lcp.tolist() == common


# 3 ------------------------------------------------------------------------------------------------


def brute3(rows, least=50):
    firsts, windows = {}, []
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = [(n, x.strip(" \t\r")) for n, x in enumerate((t or "").split("\n")) if re.search(r"[^ \t\r]", x)]
        size = [len(re.findall(r"[^ \t\r]+", x)) for _, x in lines]
        found = set()
        for k in range(len(lines)):
            for step in (1, -1):
                j, total = k, size[k]
                while total < least and 0 <= j + step < len(lines):
                    j += step
                    total += size[j]
                if total >= least:
                    found.add((min(j, k), max(j, k)))
        for a, b in sorted(found):
            windows.append((d, lines[a][0], lines[b][0], tuple(x for _, x in lines[a : b + 1])))
    gone = collections.defaultdict(set)
    for d, a, b, content in windows:
        if firsts.setdefault(content, (d, a)) != (d, a):
            gone[d].update(range(a, b + 1))
    return {d: (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d]), len(gone[d])) for d, t, *_ in rows}


def test_repeated_lines(docs, rows, no_docs):
    clash = docs.withColumn("removed_lines", F.lit("x")).withColumn("runs", F.lit(1)).withColumn("th", F.lit(2))
    got = by_id(line_dedup.dedup_lines(clash), "doc_id", "text", "removed_lines")
    assert got == brute3(rows)
    assert sum(v[1] for v in got.values()) > 5
    assert line_dedup.dedup_lines(no_docs).count() == 0


# 2 ------------------------------------------------------------------------------------------------


def test_near_vectors(spark):
    rnd = np.random.default_rng(3)
    rows, centre = [], rnd.standard_normal(16)
    for n in range(200):
        rows.append((n, (centre + rnd.standard_normal(16) * 0.03).astype("f4").tolist(), 1))
    for n in range(200, 400):
        v = rnd.standard_normal(16)
        rows.append((n, v.tolist(), n % 3))
        rows.append((n + 1000, (v * 2 + rnd.standard_normal(16) * 0.05 * (n % 4)).tolist(), n % 3))
    rows += [(5000, rows[0][1], 1), (5001, rows[0][1], 1), (5002, rows[0][1], None), (5003, None, 1), (5004, [0.0] * 16, 1), (5005, [float("nan")] * 16, 1), (5006, [None] + [1.0] * 15, 1), (5007, [], 1), (5008, [1.0, 2.0], 1), (None, rows[0][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit(1)).repartition(3)
    groups, links = Groups(), collections.Counter()
    ok = [(i, np.array(v, "f4").astype(float), c) for i, v, c in rows if i is not None and c is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for (i, v, c), (j, u, d) in itertools.combinations(ok, 2):
        if c == d and len(v) == len(u) and v @ u / np.sqrt((v @ v) * (u @ u)) >= 0.98:
            groups.join(i, j)
            links[i] += 1
            links[j] += 1
    want = {i: (links[i], None if i is None else groups.find(i), i is None or groups.find(i) == i) for i, *_ in rows}
    for block in (64, 512):
        assert by_id(embed_dedup.near_duplicates(df, block=block, window=16), "vec_id", "n_links", "component_id", "kept") == want
    assert embed_dedup.near_duplicates(df.where("false")).count() == 0


# 1 ------------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    field = quality_crf.fit(docs, labels.withColumn("text", F.lit("clash")), rounds=80)
    scored = quality_crf.score(docs.withColumn("quality_score", F.lit("old")), field).join(labels, "doc_id").where(quality_crf.held_out(F.col("doc_id"))).select("quality_score", "quality").collect()
    right = [(r[0] >= quality_crf.THRESHOLD) == bool(r[1]) for r in scored]
    assert len(right) > 40 and np.mean(right) > 0.97


def test_quality_of_odd_rows(docs, no_docs, rows):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    field = quality_crf.fit(docs, labels, rounds=5)
    got = by_id(quality_crf.score(docs, field), "doc_id", "quality_score")
    assert len(got) == len(rows) and all(0 <= v[0] <= 1 for v in got.values())
    assert quality_crf.score(no_docs, field).count() == 0
    unlearned = quality_crf.fit(no_docs, labels)
    assert {v[0] for v in by_id(quality_crf.score(docs, unlearned), "doc_id", "quality_score").values()} == {0.5}


def test_marginals_equal_enumeration():
    rnd = np.random.default_rng(0)
    good, trans, first = rnd.standard_normal(9), rnd.standard_normal((2, 2)), np.array([0, 4, 5, 9])
    p, pair = quality_crf.forward_backward(good, trans, quality_crf.chains(first))
    for a, b in itertools.pairwise(first):
        total, ones, pairs = 0.0, np.zeros(b - a), np.zeros((b - a, 2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(good[a + t] * y[t] for t in range(b - a)) + sum(trans[y[t - 1], y[t]] for t in range(1, b - a)))
            total += w
            ones += w * np.array(y)
            for t in range(1, b - a):
                pairs[t, y[t - 1], y[t]] += w
        assert np.allclose(p[a:b], ones / total) and np.allclose(pair[a:b], pairs / total)


# 4 ------------------------------------------------------------------------------------------------


def test_rollup_of_signed_batches(spark, docs, rows, no_docs, tmp_path):
    counts = {"words": token_rollup.word_counter, "chars": len}
    r = token_rollup.Rollup(spark, f"file://{tmp_path}/r", counts)
    state = {i if i is not None else object(): (t or "", lang, source) for i, t, lang, source, _ in rows}

    def check():
        want = collections.defaultdict(lambda: [0, 0])
        for t, lang, source in state.values():
            for name, f in counts.items():
                want[source, lang, name][0] += 1
                want[source, lang, name][1] += f(t)
        got = {(x["source"], x["lang"], x["tokenizer"]): [x["n_docs"], x["n_tokens"]] for x in r.totals().collect()}
        assert got == dict(want)

    assert r.totals().count() == 0
    assert r.commit("a", docs.withColumn("deleted", F.lit(False)))
    check()
    assert not r.commit("a", docs)  # again
    check()
    change = [(0, "one two", "de", "new", False, 1), (0, "one two three", "de", "new", False, 2), (1, None, None, None, True, 1), (77777, "x", None, None, True, 1), (99, "fresh text here", "en", None, False, 1), (99, "fresh text here", "en", None, False, 1)]
    assert r.commit("b", spark.createDataFrame(change, "doc_id long, text string, lang string, source string, deleted boolean, seq long"))
    state[0], state[99] = ("one two three", "de", "new"), ("fresh text here", "en", None)
    del state[1]
    check()
    assert r.commit("c", no_docs)
    check()
    # what an attempt wrote before it failed is never read
    r.counted(docs.selectExpr("doc_id", "text", "source", "lang", "false as deleted", "0L as seq")).write.parquet(f"file://{tmp_path}/r/data/{'d'.encode().hex()}-x/ledger")
    check()


# 8 ------------------------------------------------------------------------------------------------


def page(*body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{''.join(body)}</body></html>"


def test_main_text_of_marked_articles(spark):
    furniture = '<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use</div><div class="ad">Buy</div>'
    article = "<article><header class='post-header'><h1>Head &amp; line</h1></header><p>One  two\n three<p>Four <b>five</b>, six<br>seven<aside>no</aside><div class='comments'><p>reader</p></div><script>var t='</p>';</script><form><input>no</form></article>"
    p = [(1, "http://a.org/x", page(furniture, article, "<footer>end</footer>")), (2, "http://a.org/y", page(furniture, "<div>no article</div>")), (3, "http://b.org/", page("<div>plain</div><p>text &lt;3 &#233;", "<footer>end")), (4, None, None), (5, "", ""), (6, "http://a.org/z", "<p>broken <b"), (7, "http://c.org", "just text")]
    df = spark.createDataFrame(p, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = by_id(html_extract.extract(df), "page_id", "text")
    assert got[1][0] == "Head & line\nOne two three\nFour five, six\nseven"
    assert got[2][0] == "no article" and got[3][0] == "plain\ntext <3 é" and got[4][0] == got[5][0] == "" and got[7][0] == "just text"
    assert html_extract.extract(df.where("false")).count() == 0


def test_wrappers_accept_what_they_were_made_of():
    rnd = random.Random(5)
    for _ in range(200):
        streams = []
        for _ in range(6):
            s = ["body", "nav"] + ["li", "Tx", "/li"] * rnd.randint(1, 4) + ["/nav", "article"]
            if rnd.random() < 0.5:
                s += ["h1", "Tm", "/h1"]
            for _ in range(rnd.randint(0, 5)):
                s += rnd.choice([["p", "Tm", "/p"], ["p", "b", "Tm", "br"], ["img"]])
            s += ["/article"] + rnd.choice([[], ["footer", "Tx", "/footer"]])
            streams.append(html_extract.fold(s))
        wrapper = streams[0]
        for s in streams[1:]:
            if not html_extract.accepts(wrapper, s):
                wrapper = html_extract.generalise(wrapper, s)
        assert html_extract.accepts(wrapper, streams[-1]) or html_extract.slots(wrapper) >= html_extract.slots(streams[-1])
        assert html_extract.thawed(__import__("json").loads(__import__("json").dumps(wrapper))) == wrapper


def test_pages_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    import html as h

    got = by_id(html_extract.extract(df), "page_id", "text")
    for r in df.collect():
        inner = re.search(r"(?s)<article>(.*?)(</article>|$)", r["html"])[1]
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br|article)>", inner)]
        assert got[r["page_id"]][0] == "\n".join(b for b in blocks if b)


# shared -------------------------------------------------------------------------------------------


def test_words_of_rows():
    from corvane.llm.common import Words

    column = pa.array(["Ab cd", None, "", "ef", "gh,IJ"]).slice(0, 5)
    w = Words(column, decontaminate.LETTERS)
    assert np.diff(w.first).tolist() == [2, 0, 0, 1, 2]
    assert w.hash[0] == Words(pa.array(["aB"]), decontaminate.LETTERS).hash[0]


@pytest.mark.parametrize("few", [0, 400_000])
def test_components(spark, monkeypatch, few):
    from corvane.llm import common
    from corvane.llm.common import components

    monkeypatch.setattr(common, "EDGES_IN_A_TASK", few)

    rnd = random.Random(6)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5), (500, 501), (501, 500)]
    groups = Groups()
    for a, b in pairs:
        groups.join(a, b)
    got = dict(components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {x: groups.find(x) for p in pairs if p[0] != p[1] for x in p}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
