"""Each operator against a brute-force version, a round trip or held-out accuracy, on small tables with odd rows."""

import collections
import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm import queries as Q
from tidemark.llm.components import components
from tidemark.llm.debruijn_dedup import substring_dedup
from tidemark.llm.decontamination import WINDOW, allowed, decontaminate, overlaps, seed_masks
from tidemark.llm.language_id import identify
from tidemark.llm.mixing import mix, mixed
from tidemark.llm.quality import quality
from tidemark.llm.simhash_dedup import _linked, op10_simhash
from tidemark.llm.similar import one_of_each, similar_groups
from tidemark.llm.suffix_dedup import multikey_sort, suffix_dedup
from tidemark.llm.token_shards import PATTERN, TOKENIZER, feistel, read_sequences, training_order, write_shards
from tidemark.llm.topk_search import top_k
from tidemark.llm.toxicity import marginals, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, id long, key string"
WORD = r"[^\x20\x09-\x0D]+"


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, None, 0.5, "x", 1, "k")


@pytest.fixture(scope="module")
def odd(spark):
    """Real documents with clashing extra columns, and nulls, blanks, ties, long words and loops."""
    rows = [doc(r.doc_id, r.text, r.lang, r.source) for r in Q.table(spark, SF, "documents").select("doc_id", "text", "lang", "source").collect()]
    long_run = " ".join(f"w{i % 50}" for i in range(400))
    rows += [doc(1001, None), doc(1002, ""), doc(1003, " \t\n"), doc(1004, "a"), doc(1005, "x" * 1500), doc(1006, "x" * 1500 + "é"), doc(1007, long_run), doc(1008, "ab " * 300), doc(1009, "ñé 日本語 " * 90, None, None), doc(1010, "1234 56!"), doc(1011, long_run[:200])]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(WORD, t or "")


def test_kernels():
    texts = [b"", b"a bb  c", b" ", b"dd\te\n", b"f"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    s, e, first = K.words(data, offsets)
    got = [[data[s[i] : e[i]].tobytes() for i in range(first[r], first[r + 1])] for r in range(5)]
    assert got == [t.split() for t in texts]
    h = K.span_hash(K.prefix(np.frombuffer(b"abcXabc", np.uint8)), np.array([0, 4, 1]), np.array([3, 7, 3]))
    assert h[0] == h[1] != h[2]
    assert K.take_ranges(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    rng = np.random.default_rng(1)
    order = rng.integers(1, 9, 200).astype(np.uint32)
    at = set(K.anchors(order, 7, np.array([0, 120, 204]), 5).tolist())
    for a, b in ((0, 120), (120, 204)):
        for i in range(a, b - 10):
            assert any(p in at for p in range(i, i + 7) if order[p] == order[i : i + 7].min())


def test_multikey_sort():
    rows = np.random.default_rng(2).integers(0, 2, (300, 20)).astype(np.uint8)
    assert [r.tobytes() for r in rows[multikey_sort(rows)]] == sorted(r.tobytes() for r in rows)


def test_suffix_dedup(spark, odd, empty):
    got = sorted(tuple(r) for r in suffix_dedup(odd).collect())
    seen, want = set(), []
    for i, t in sorted((r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(b[s : s + 100])
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()).hexdigest()))
    assert got == want
    assert suffix_dedup(empty).count() == 0


def test_equal_places_do_not_remove_each_other(spark):
    text = "lorem ipsum " * 20
    one = spark.createDataFrame([doc(7, text), doc(7, text)], SCHEMA)
    single = suffix_dedup(one.limit(1)).collect()[0]
    assert [tuple(r) for r in suffix_dedup(one).collect()] == [tuple(single)] * 2
    null_id = spark.createDataFrame([doc(None, "q" * 150), doc(3, "q" * 90)], SCHEMA)
    assert {r.doc_id: r.n_removed for r in suffix_dedup(null_id).collect()} == {None: 149, 3: 0}


def test_substring_dedup(spark, odd, empty):
    twice = odd.union(odd.where("doc_id in (1004, 1007)"))
    rows = twice.select("doc_id", "text").collect()
    count = collections.Counter(tuple(w[s : s + 35]) for _, t in rows for w in [words(t)] for s in range(len(w) - 34))
    want = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - 34):
            if count[tuple(w[s : s + 35])] > 1:
                gone[s : s + 35] = [True] * 35
        want.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    assert sorted(tuple(r) for r in substring_dedup(twice).collect()) == sorted(want)
    assert substring_dedup(empty).count() == 0


def simhash(t, k=3):
    w = words((t or "").translate({i: i + 32 for i in range(65, 91)}))
    s = [" ".join(w[i : i + k]) for i in range(max(len(w) - k + 1, min(len(w), 1)))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, odd, empty):
    rows = odd.select("doc_id", "text").collect()
    f = {r.doc_id: simhash(r.text) for r in rows}
    comp = dict.fromkeys(f)
    for i in sorted(f):
        if comp[i] is None:
            todo = [i]
            comp[i] = i
            while todo:
                a = todo.pop()
                for b in f:
                    if comp[b] is None and (f[a] ^ f[b]).bit_count() <= 2:
                        comp[b] = i
                        todo.append(b)
    got = op10_simhash(odd).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f[i]:016x}", comp[i]) for i in f}
    assert op10_simhash(empty).count() == 0


def shingle_set(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = words(low)
    return frozenset([" ".join(w[i : i + 5]) for i in range(len(w) - 4)] or ([" ".join(w)] if w else []))


def similar_by_brute_force(rows, similarity=0.8):
    """Least doc_id reachable over pairs whose five-word shingle sets reach the similarity."""
    sets = {r.doc_id: shingle_set(r.text) for r in rows}
    comp = dict.fromkeys(sets)
    for i in sorted(sets):
        if comp[i] is None:
            todo, comp[i] = [i], i
            while todo:
                a = sets[todo.pop()]
                for b in sets:
                    if comp[b] is None and (a == sets[b] or len(a & sets[b]) >= similarity * len(a | sets[b])):
                        comp[b] = i
                        todo.append(b)
    return comp


def test_similar_groups_match_brute_force(spark, odd, empty):
    rng = np.random.default_rng(7)
    base = [f"t{x}" for x in rng.integers(0, 9000, 160)]
    made = []
    # One text with words replaced, from close copies to ones on both sides of the threshold, and chains of edits.
    for i in range(60):
        now = list(made[-1][1].split()) if i % 3 == 2 else list(base)
        for at in rng.integers(0, 160, 1 + i % 6):
            now[at] = f"u{i}"
        made.append(doc(2000 + i, " ".join(now)))
    made += [doc(3000, "Some Words"), doc(3001, "some  words"), doc(3002, "some words"), doc(3003, "one two three four five six")]
    docs = odd.union(spark.createDataFrame(made, SCHEMA))
    want = similar_by_brute_force(docs.select("doc_id", "text").collect())
    got = similar_groups(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(got) == len(want)
    assert len(set(want.values())) < len(want) - 40
    nulls = docs.union(docs.limit(3)).union(spark.createDataFrame([doc(None, base[0]), doc(None, base[0])], SCHEMA))
    kept = one_of_each(nulls)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(None) == 2
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values()))
    assert similar_groups(empty).count() == 0
    assert one_of_each(empty).count() == 0


def test_members_apart_after_the_pivots_are_compared(spark, monkeypatch):
    import tidemark.llm.similar as M

    rng = np.random.default_rng(3)
    shared = [f"s{x}" for x in range(150)]
    docs = [doc(i, " ".join(shared + [f"g{i // 2}x{j}" for j in range(60)] + [f"d{i}"])) for i in range(40)]
    table = spark.createDataFrame([docs[i] for i in rng.permutation(40)], SCHEMA)
    want = similar_by_brute_force(table.collect())
    assert set(want.values()) == set(range(0, 40, 2))
    monkeypatch.setattr(M, "PIVOTS", 1)
    assert {r.doc_id: r.component_id for r in similar_groups(table).collect()} == want


def test_large_groups_link_as_small_ones():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
    x = np.unique(np.concatenate([base[i % 60] ^ (np.uint64(1) << rng.integers(0, 63, 1, dtype=np.uint64)) for i in range(2600)]))
    import tidemark.llm.simhash_dedup as M

    whole, M.BLOCK = M.BLOCK, 100
    try:
        cut = _linked(x, 2)
        M.BLOCK = 10_000
        assert (cut == _linked(x, 2)).all()
    finally:
        M.BLOCK = whole


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (98, 98), (7, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 98: 98, 99: 98, 100: 98}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_masks_hit_every_pattern():
    from itertools import combinations

    for n in range(1, WINDOW + 1):
        for gone in combinations(range(n), allowed(n)):
            assert any(not {i + o for o in m} & set(gone) for m in seed_masks(n) for i in range(n - m[-1]))


def test_decontamination(spark, empty):
    rng = np.random.default_rng(5)
    vocab = [f"v{i}" for i in range(3000)]
    text = lambda n: [str(x) for x in rng.choice(vocab, n)]
    items = [text(n) for n in (40, 30, 13, 11, 8, 4, 1)] + [[]]
    bench = spark.createDataFrame([(i, " ".join(t), 0.0) for i, t in enumerate(items)] + [(99, None, 0.0)], "item_id long, text string, score double")
    rows = []
    for d in range(120):
        t = text(int(rng.integers(0, 120)))
        if d % 3 == 0:
            item = list(items[d % 7])
            for p in rng.choice(len(item), min(len(item), int(rng.integers(0, 4))), replace=False):
                item[p] = "changed"
            at = int(rng.integers(0, len(t) + 1))
            t[at:at] = item[int(rng.integers(0, 3)) :] if len(item) > 20 else item
        rows.append((d, ", ".join(t).upper()))
    docs = spark.createDataFrame([doc(*r) for r in rows] + [doc(500, None), doc(501, "")], SCHEMA)

    def hit(t, q):
        a, b = re.findall(r"[a-z0-9]+", t.lower()), q
        n = min(len(b), WINDOW)
        return n and any(sum(x == y for x, y in zip(a[i : i + n], b[j : j + n], strict=True)) >= n - allowed(n) for i in range(len(a) - n + 1) for j in range(len(b) - n + 1))

    want = {(d, i) for d, t in rows for i, q in enumerate(items) if hit(t, q)}
    assert {(r.doc_id, r.item_id) for r in overlaps(docs, bench).collect()} == want and len(want) > 20
    clean = decontaminate(docs, bench)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}
    assert overlaps(empty, bench).count() == 0
    assert overlaps(docs, bench.limit(0)).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.normal(0, 1, 16)], "c") for i in range(900)]
    rows += [(900, None, "c"), (901, [], "c"), (902, [1.0, None], "c"), (903, [float("nan")] * 16, "c"), (904, [2.0, -1.0], "c"), (1000, [0.5] * 16, "c"), (1001, rows[7][1], "c"), (None, [1.0] * 16, "c")]
    vecs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    whole = {i: np.pad(np.floor(np.array(v) * 1024).astype(np.int64), (0, 16 - len(v))) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    want = {(q, n + 1, i, s) for q in whole if q % 100 == 0 for n, (s, i) in enumerate(sorted(((int(whole[q] @ x), i) for i, x in whole.items() if i != q), key=lambda t: (-t[0], t[1]))[:10])}
    assert {tuple(r) for r in top_k(vecs).collect()} == want
    assert top_k(vecs.limit(0)).count() == 0
    assert top_k(vecs.where("vec_id in (0, 5)")).count() == 1


def test_mixing(spark, odd, empty):
    got = mix(odd).toPandas()
    assert len(got) == odd.count()
    rows = {r.doc_id: r for r in odd.collect()}
    assert all(r["size"] == len(words(rows[r.doc_id].text)) for _, r in got.iterrows())
    assert (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    got["source"] = [rows[i].source for i in got.doc_id]
    by = got.groupby("source", dropna=False).agg(size=("size", "sum"), own=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.own).all()
    order = sorted(by.index, key=lambda s: (s != s or s is None, s if isinstance(s, str) else ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    goal, capped = {}, set()
    while True:
        rest = by["size"].sum() - sum(3 * by["size"][s] for s in capped)
        level = rest / sum(w for s, w in weight.items() if s not in capped)
        more = {s for s in weight if s not in capped and weight[s] * level > 3 * by["size"][s]}
        if not more:
            break
        capped |= more
    goal = {s: 3 * by["size"][s] if s in capped else weight[s] * level for s in weight}
    for s in order:
        assert by.target[s] == pytest.approx(goal[s])
        assert abs(by.taken[s] - by.target[s]) <= max(50, 0.02 * by.target[s])
    assert mix(odd).toPandas().sort_values("doc_id").equals(mix(odd.repartition(3)).toPandas().sort_values("doc_id").reset_index(drop=True)) or sorted(map(tuple, mix(odd).collect()), key=str) == sorted(map(tuple, mix(odd.repartition(3)).collect()), key=str)
    assert mixed(odd).count() == int(got.copies.sum())
    assert mix(empty).count() == 0


def test_mixing_is_native(spark, odd):
    plan = mix(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_language(spark, odd, empty):
    got = {r.doc_id: r for r in identify(odd).collect()}
    assert {got[i].lang_pred for i in (1001, 1002, 1003, 1010)} == {"und"}
    real = [r for r in odd.where("doc_id < 1000").collect()]
    held = [got[r.doc_id].lang_pred == r.lang for r in real if got[r.doc_id].held_out]
    assert len(held) > 20 and np.mean(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert identify(empty).count() == 0
    assert {r.lang_pred for r in identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    by = {lang: next(r.text for r in real if r.lang == lang and len(r.text) > 1500) for lang in ("en", "de")}
    both = odd.union(spark.createDataFrame([doc(2001, by["en"][:1500] + " " + by["de"][:1500])], SCHEMA))
    (row,) = identify(both).where("doc_id = 2001").collect()
    assert row.lang_set == "de,en" and 0.3 < row.score < 0.8


@pytest.mark.parametrize(("make", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, make, label, empty):
    docs, labels = (Q.table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    extra = spark.createDataFrame([(9001, None), (9002, ""), (9003, "!"), (None, "text")], "doc_id long, text string")
    whole = docs.select("doc_id", "text").union(extra).withColumn("score", F.lit("clash"))
    got = make(whole, labels.withColumn("text", F.lit("clash"))).toPandas()
    assert len(got) == docs.count() + 4
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    both = got.merge(labels.toPandas(), on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held[label]).mean() > 0.95
    again = make(whole, labels.withColumn("text", F.lit("clash"))).toPandas().drop(columns="spans", errors="ignore")
    assert again.sort_values("doc_id").reset_index(drop=True).equals(got.drop(columns="spans", errors="ignore").sort_values("doc_id").reset_index(drop=True))
    assert make(empty, labels).count() == 0
    assert make(whole, labels.limit(0)).count() == len(got)
    if label == "toxic":
        spans = got[(got.doc_id == both[both.toxic == 1].doc_id.iloc[0])].spans.iloc[0]
        assert all(s["begin"] < s["stop"] for s in spans)


def test_marginals_match_enumeration():
    from itertools import product

    u, move = np.array([0.3, -1.0, 2.0, 0.5]), np.array([[1.0, 0.4], [1.0, 3.0]])
    total, on = 0.0, np.zeros(4)
    for tags in product((0, 1), repeat=4):
        v = np.exp(sum(x for x, t in zip(u, tags, strict=True) if t)) * move[0, tags[0]] * np.prod([move[a, b] for a, b in zip(tags, tags[1:], strict=False)])
        total += v
        on += v * np.array(tags)
    p = on / total
    assert np.allclose(marginals(u, np.array([0]), np.array([4]), move), np.log(p / (1 - p)))


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 1000, 4097):
        assert sorted(feistel(np.arange(n), n, 7).tolist()) == list(range(n))
    assert feistel(np.arange(1000), 1000, 7).tolist() != feistel(np.arange(1000), 1000, 8).tolist()


def test_token_shards(spark, odd, empty, tmp_path):
    import base64

    import tiktoken

    docs = odd.union(odd.where("doc_id = 1007")).union(spark.createDataFrame([doc(None, "null id")], SCHEMA))
    order = training_order(docs, length=64, per_shard=100).cache()
    rows = order.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    done = write_shards(order, f"file://{tmp_path}").collect()
    assert sum(r.n for r in done) == len(rows)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TOKENIZER, "rb"))}
    codec = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    by = collections.defaultdict(list)
    for r in rows:
        (ids,) = read_sequences(f"{tmp_path}/shard-{r.shard:06d}.bin", r.slot % 100, 1, 64)
        assert len(ids) == r.n_tokens and r.byte_offset == r.slot % 100 * (4 + 128)
        by[r.doc_id].append((r.seq, ids))
    for r in odd.select("doc_id", "text").collect():
        if r.doc_id != 1007:
            ids = np.concatenate([x for _, x in sorted(by[r.doc_id], key=lambda t: t[0])])
            assert ids[-1] == 50256 and codec.decode_bytes(ids[:-1].tolist()).decode() == (r.text or "")
    again = training_order(docs.repartition(5), length=64, per_shard=100).select("slot", "doc_id", "seq").collect()
    assert sorted(again, key=str) == sorted(order.select("slot", "doc_id", "seq").collect(), key=str)
    assert training_order(empty).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as C

    docs = Q.table(spark, SF, "documents")
    names = [n for n, _ in C.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "mixing", "token_ids"]
    extra = spark.createDataFrame([(5001, "12 34 !!", "en", "z", 8), (5002, docs.first().text, "en", "z", 8)], docs.schema)
    now = docs.union(extra)
    counts = []
    for name, stage in C.STAGES[:4]:
        now = stage(spark, now, SF).cache()
        assert now.columns == docs.columns
        ids = [r.doc_id for r in now.select("doc_id").collect()]
        counts.append(len(ids))
        assert 5001 not in ids
        if name != "language_id":
            assert 5002 not in ids
        if name == "decontamination":
            assert not {r.doc_id for r in overlaps(docs, Q.table(spark, SF, "benchmark")).collect()} & set(ids)
    assert counts[0] == docs.count() + 1 > counts[1] > counts[2]
    assert C.run(spark, SF).count() > 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    found = entry.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in found) == 1
    assert "pipeline" in found
