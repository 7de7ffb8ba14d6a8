"""Groups of rows whose sets of word shingles are similar: SimHash links completed by exact prefix filtering.

At a Jaccard similarity of 0.8 two SimHash fingerprints still differ in some ten of 64
bits, beyond what deletion variants can index. So the fingerprint links give only
the first candidates. All others come from prefixes: every set is ordered by the number of
texts that hold a shingle, rarest first, and of two sets at the threshold one of the
first n - ceil(0.8 n) + 1 shingles of either is common to both. This holds for every
pair; nothing is estimated, capped or sampled. What very many texts share stands at the
end of the order and is in a prefix only where a set has hardly anything else.

Equal sets collapse to one representative first. A shingle's group is not expanded into its
pairs: all members are compared with one pivot, the member with the fewest rarer
shingles, to which whatever is similar to anything in the group mostly is similar too. What
is still apart is compared outside the group's largest part only, and there by cells: members of
one size and one place of the shingle, which are paired only where these leave the
similarity possible. Whole sets verify every link. Hot keys are dealt over salts.

Defined results: a null text counts as empty; texts without words are equal to each other;
fewer words than a shingle make one shingle of them all; a very long text is one set like any
other and needs memory in proportion to its words; ties between rows go by doc_id, text hash, then
further columns; an empty table gives no rows; further columns are kept and never read.
``one_row_of_each`` decides on rows, whatever their doc_id: null and repeated ids take part with
each of their texts. In ``similar_groups`` rows with equal doc_id count as one
document and a null doc_id is in no group. Sets are known by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.components import components
from tidemark.llm.rows import others, row_key
from tidemark.llm.simhash_dedup import fingerprint_links, fold_bits
from tidemark.llm.skew import join_counted, join_salted, matching
from tidemark.llm.store import discard, materialize

#: Rounds that compare each group's members with one pivot before parts are compared across.
PIVOTS = 1
#: Slices of the shingles, one after another, so that their shuffle and its counts take less disk and memory.
SLICES = 3
#: Bytes of text that one kernel call works on.
CHUNK = 1 << 20
#: What equal sets share.
SAME = ["content", "fp", "size"]
#: Comparisons of one salt of a hot group across its parts.
COMPARED = 1 << 22


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): each row's distinct shingle hashes in ascending order."""
    low = K.LOWER[data]
    starts, ends, first = K.words(low, offsets)
    sums = K.word_sums(K.span_hash(K.prefix(low), starts, ends))
    n = np.diff(first)
    of = np.maximum(n - shingle + 1, np.minimum(n, 1))
    begin = K.take_ranges(first[:-1], of)
    h = K.span_hash(sums, begin, np.minimum(begin + shingle, np.repeat(first[1:], of)))
    first = np.concatenate(([0], np.cumsum(of)))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[first[:-1][first[:-1] < len(h)]] = True
    return h[new], np.concatenate(([0], np.cumsum(new)))[first]


def _signature_rows(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in K.chunks(batch, limit=CHUNK):
                h, first = shingle_sets(data, offsets, shingle)
                size = np.diff(first)
                content = np.zeros(len(size), np.uint64)
                if len(h):
                    content[size > 0] = np.add.reduceat(K.mix(h), first[:-1][size > 0])
                cols = [*(batch.column(i).slice(row, end - row) for i in range(2)), pa.array(content.view(np.int64)), pa.array(fold_bits(h, first).view(np.int64)), pa.array(size.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "th", *SAME])

    return run


def _set_rows(shingle: int, part: int, parts: int):
    """Each representative's hashes, of ``parts`` slices by hash the one numbered ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in K.chunks(batch, limit=CHUNK):
                h, first = shingle_sets(data, offsets, shingle)
                if parts > 1:
                    own = h % np.uint64(parts) == part
                    h, first = h[own], np.concatenate(([0], np.cumsum(own)))[first]
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), lists], names=["rep", "hashes"])

    return run


def _sets(texts: DataFrame, shingle: int, part: int = 0, parts: int = 1) -> DataFrame:
    return texts.select("rep", F.col("row.text").cast("string").alias("text")).mapInArrow(_set_rows(shingle, part, parts), "rep long, hashes array<long>")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have at least this Jaccard similarity; ``pairs`` is a written table."""
    needed = materialize(pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct())
    sets = materialize(_sets(matching(texts, needed, "rep"), shingle))
    counts = materialize(pairs.groupBy("a").agg(F.count("*").alias("n")).join(sets.select(F.col("rep").alias("a"), F.col("hashes").alias("ha")), "a"))
    both = join_counted(pairs, counts, "a", "b").join(sets.select(F.col("rep").alias("b"), F.col("hashes").alias("hb")), "b")
    shared = F.size(F.array_intersect("ha", "hb"))
    total = F.size("ha") + F.size("hb") - shared
    found = materialize(both.where(shared >= F.lit(similarity) * total - 1e-9).select("a", "b"))
    for table in (needed, sets, counts):
        discard(table)
    return found


def _possible(similarity: float, a: str, b: str) -> Column:
    """Whether sizes and places of the first shingle in common leave the similarity possible."""
    size_a, size_b, at_a, at_b = (F.col(f"{x}.{c}") for c in ("size", "pos") for x in (a, b))
    return F.least(size_a - at_a, size_b - at_b) >= F.lit(similarity / (1 + similarity)) * (size_a + size_b) - 1e-6


def prefixes(texts: DataFrame, reps: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Written (key, m): the shingles in each representative's prefix that other texts hold too; m: rep, size, pos."""
    found = []
    for part in range(SLICES):
        rows = _sets(texts, shingle, part, SLICES)
        common = materialize(rows.select(F.explode("hashes").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("texts", F.col("n")))
        found.append(materialize(join_counted(rows.select("rep", F.explode("hashes").alias("key")), common, "key", "rep")))
        discard(common)
    shared = found[0]
    for more in found[1:]:
        shared = shared.unionByName(more)
    # Shingles that no other text holds stand first; a set with too many of them has nothing to share in its prefix.
    lists = shared.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("texts", "key"))).alias("order")).join(reps.select("rep", "size"), "rep")
    spare = F.col("size") - F.size("order")
    most = F.floor(F.col("size") * F.lit(1 - similarity) + 1e-9)
    placed = lists.where(spare <= most).select("rep", "size", F.posexplode(F.slice("order", F.lit(1), (most - spare + 1).cast("int"))).alias("at", "s"), spare.alias("spare"))
    out = materialize(placed.select("s.key", F.struct("rep", "size", (F.col("spare") + F.col("at")).alias("pos")).alias("m")))
    for table in found:
        discard(table)
    return out


def _rooted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``members`` with the root of each one's part."""
    if roots is None:
        return members.withColumn("root", F.col("m.rep"))
    named = roots.select(F.col("node").alias("rep"), F.col("root").alias("found"))
    return members.withColumn("rep", F.col("m.rep")).join(named, "rep", "left").select("key", "m", F.coalesce("found", "rep").alias("root"))


def pivot_pairs(members: DataFrame, similarity: float, turn: int) -> DataFrame:
    """Written (a, b): each member of a group with several parts and the group's pivot, each pair once."""
    # The fewer rarer shingles, the more central; later turns take the next best at random.
    first = (F.col("m.pos") / F.col("m.size") if turn == 0 else F.lit(0.0)).alias("share")
    pivots = members.groupBy("key").agg(F.min(F.struct(first, F.xxhash64(F.lit(turn), "m.rep").alias("tie"), "m", "root")).alias("p"), F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    pivots = materialize(pivots.where("lo <> hi").select("key", F.col("p.m").alias("p"), F.col("p.root").alias("p_root"), "n"))
    pairs = join_counted(members, pivots, "key", "m.rep").where((F.col("root") != F.col("p_root")) & _possible(similarity, "m", "p")).select(F.col("p.rep").alias("a"), F.col("m.rep").alias("b"))
    # A pair may have either end as pivot in different groups: one of them stays.
    once = pairs.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min(F.struct("a", "b")).alias("p"))
    out = materialize(once.select("p.a", "p.b"))
    discard(pivots)
    return out


def _cell() -> Column:
    return F.xxhash64("key", "m.size", "m.pos")


def _partners(open_: DataFrame, similarity: float) -> DataFrame:
    """Written (x, y, spread): cells of one key that sizes and places let be similar, x with members outside the largest part.

    A cell is what the members of a key with one size and place make up, so infeasible members are never paired,
    only their cells are; and of these only ones whose sizes lie in the same or in neighbouring classes.
    """
    kind = F.floor(F.log(F.col("m.size")) / -F.log(F.lit(similarity))).cast("int").alias("kind")
    cells = materialize(open_.groupBy("key", _cell().alias("cell"), kind, F.struct("m.size", "m.pos").alias("at")).agg(F.count("*").alias("n"), F.count_if(F.col("root") != F.col("main")).alias("outside"), F.min("root").alias("lo"), F.max("root").alias("hi")))
    left = cells.where("outside > 0").select("key", F.explode(F.sequence(F.col("kind") - 1, F.col("kind") + 1)).alias("kind"), F.col("cell").alias("x"), F.col("at").alias("x_at"), "outside", F.col("lo").alias("x_lo"), F.col("hi").alias("x_hi"))
    right = cells.select("key", "kind", F.col("cell").alias("y"), F.col("at").alias("y_at"), "n", "lo", "hi")
    several = (F.col("lo") != F.col("hi")) | (F.col("x_lo") != F.col("x_hi")) | (F.col("lo") != F.col("x_lo"))
    met = left.join(right, ["key", "kind"]).where(several & _possible(similarity, "x_at", "y_at"))
    out = materialize(met.select("x", "y", F.greatest(F.lit(1), F.ceil(F.col("outside").cast("double") * F.col("n") / COMPARED)).cast("int").alias("spread")))
    discard(cells)
    return out


def across_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """Written (a, b): pairs in different parts of a group; ``a`` is never in its largest part."""
    by_part = members.groupBy("key", "root").agg(F.count("*").alias("c"))
    groups = by_part.groupBy("key").agg(F.max(F.struct("c", "root")).alias("most"), F.sum("c").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    groups = materialize(groups.select("key", F.col("most.root").alias("main"), "n"))
    open_ = materialize(join_counted(members, groups, "key", "m.rep"))
    partners = _partners(open_, similarity)
    ends = materialize(partners.select(F.col("x").alias("cell")).unionByName(partners.select(F.col("y").alias("cell"))).distinct())
    active = materialize(matching(open_.withColumn("cell", _cell()), ends, "cell"))
    deal = F.pmod(F.xxhash64("y.rep"), F.col("spread")).cast("int")
    left = join_salted(active.where("root <> main"), partners.withColumnRenamed("x", "cell"), ["cell"], "m.rep").select(F.col("cell").alias("cx"), F.col("y").alias("cy"), F.col("m").alias("x"), F.col("root").alias("x_root"), F.explode(F.sequence(F.lit(0), F.col("spread") - 1)).alias("turn"))
    right = join_salted(active.withColumn("y", F.col("m")), partners.select("x", F.col("y").alias("cell"), "spread"), ["cell"], "m.rep").select(F.col("x").alias("cx"), F.col("cell").alias("cy"), "y", F.col("root").alias("y_root"), (F.col("root") == F.col("main")).alias("in_main"), deal.alias("turn"))
    once = F.col("in_main") | (F.col("x.rep") < F.col("y.rep"))
    pairs = left.join(right, ["cx", "cy", "turn"]).where((F.col("x_root") != F.col("y_root")) & once & _possible(similarity, "x", "y"))
    out = materialize(pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct())
    for table in (groups, open_, partners, ends, active):
        discard(table)
    return out


def _fingerprint_pairs(reps: DataFrame, distance: int) -> DataFrame:
    """(a, b): representatives whose fingerprints deletion variants link."""
    of_fp = reps.where("size > 0").groupBy("fp").agg(F.min("rep").alias("rep"))
    ends = [of_fp.select(F.col("fp").alias(c), F.col("rep").alias(f"rep_{c}")) for c in "ab"]
    links = fingerprint_links(of_fp.select("fp"), distance).join(ends[0], "a").join(ends[1], "b")
    return links.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).where("a <> b").distinct()


def _linked(docs: DataFrame, shingle: int, similarity: float, distance: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """Written tables: every row's key and set; the sets, with their least row key; their whole rows; the roots of linked sets."""
    signed = materialize(docs.select(*row_key(), F.col("text").cast("string").alias("text")).mapInArrow(_signature_rows(shingle), "id long, th long, content long, fp long, size int"))
    reps = materialize(signed.groupBy(*SAME).agg(F.min(F.struct("id", "th")).alias("first")).withColumn("rep", F.xxhash64(*SAME)))
    # Equal rows fold before the shuffle, so that very many of them don't meet in one task.
    own = docs.select(*row_key(), F.struct("*").alias("row"), others(docs).alias("others"))
    once = own.groupBy("id", "th").agg(F.min_by("row", "others").alias("row"))
    texts = materialize(once.join(reps.select("first.id", "first.th", "rep"), ["id", "th"]).select("rep", "row"))
    members = prefixes(texts, reps, shingle, similarity)
    links, roots = verified(materialize(_fingerprint_pairs(reps, distance)), texts, shingle, similarity), None
    for turn in range(PIVOTS + 1):
        roots = roots if links.isEmpty() else materialize(components(links))
        rooted = materialize(_rooted(members, roots))
        pairs = pivot_pairs(rooted, similarity, turn) if turn < PIVOTS else across_pairs(rooted, similarity)
        discard(rooted)
        if not pairs.isEmpty():
            links = materialize(links.unionByName(verified(pairs, texts, shingle, similarity)))
    roots = roots if links.isEmpty() else materialize(components(links))
    for table in (members, links):
        discard(table)
    return signed, reps, texts, roots


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = 2) -> DataFrame:
    """(doc_id, component_id): documents connected by links of at least ``similarity`` share the least doc_id reachable."""
    signed, reps, texts, roots = _linked(docs.where("doc_id is not null"), shingle, similarity, distance)
    own = F.col("rep").alias("root")
    named = reps.select(*SAME, "first.id", own) if roots is None else reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(*SAME, "first.id", F.coalesce("root", "rep").alias("root"))
    sizes = signed.groupBy(*SAME).agg(F.count("*").alias("n"))
    least = materialize(named.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("n")))
    groups = materialize(join_counted(named, least, "root", "id").join(sizes, SAME).select(F.xxhash64(*SAME).alias("rep"), "component_id", "n"))
    found = join_counted(signed.select("id", F.xxhash64(*SAME).alias("rep")), groups, "rep", "id")
    return materialize(found.groupBy(F.col("id").alias("doc_id")).agg(F.min("component_id").alias("component_id")))


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = 2) -> DataFrame:
    """``one_row_of_each`` among the rows with a doc_id; rows with a null id all stay."""
    return one_row_of_each(docs.where("doc_id is not null"), shingle, similarity, distance).unionByName(docs.where("doc_id is null")).select(*docs.columns)


def one_row_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = 2) -> DataFrame:
    """Of each group of rows one, with all columns: the least by doc_id (null last), then text hash, then further columns."""
    signed, reps, texts, roots = _linked(docs, shingle, similarity, distance)
    if roots is None:
        return texts.select("row.*")
    inside = reps.select("rep", "first").join(roots.withColumnRenamed("node", "rep"), "rep")
    chosen = materialize(inside.groupBy("root").agg(F.min(F.struct("first", "rep")).alias("stays"), F.count("*").alias("n")))
    gone = materialize(join_counted(inside, chosen, "root", "rep").where("rep <> stays.rep").select("rep"))
    for table in (signed, reps, roots, chosen):
        discard(table)
    return matching(texts, gone, "rep", "left_anti").select("row.*")
