"""Near-duplicates by fast similarity sketching, banding and exact verification.

1. One pass over whole texts gives each document its set of hashed 5-word shingles, and from it the set's
   size, a 128-bit fingerprint, and a sketch of ``BINS`` coordinates by rounds of hashed bin placement: in
   round i every shingle falls into one random bin with value (i, hash); a bin keeps its least value, so
   later rounds only fill bins that are still empty, and rounds BINS to 2 BINS - 1 place every shingle in
   bin i - BINS, so every bin fills. A document stops after the first round that leaves no bin empty.
2. Documents with equal sets (copies) are one node from here on. A node has a number of its own, so ids may be
   null or repeat; a row is known by id and a hash of its text.
3. ``band_rows`` coordinates make a band; nodes that share a band's hash share a bucket. Two sets at the
   threshold miss all bands with a probability of at most ``MISS``: 4e-7 at 85 %, 8e-8 at 80 %.
4. Two seed pairs a node, with the first nodes that it shares buckets with, are confirmed on the full sets
   and join most groups. Pairs whose sketches agree in fewer than ``least_agreement`` of the bins (6.5
   standard errors below the threshold) need no confirmation.
5. Buckets that then still hold several components are compared whole, inside tasks of bounded blocks: by
   sketch first, and members with a likely partner in another component by full sets. A large component has
   blocks of its own, which meet the blocks of others only. Only links enough to join the components leave a
   task, so no pairs are listed, and none that could join two is left out.
6. Confirmed links contract components: each takes the neighbour with the least hash until no link joins
   two of them, a logarithmic number of joins.

The lineage is cut by reliable checkpoints after each step, and nothing is gathered on the driver. Rows of very
large buckets meet what is known of the bucket by a broadcast of bounded size, not in one task.

Edge cases
* null, empty and white-space texts: n_shingles 0, linked with nothing, each kept.
* fewer than five words: the whole word sequence is the only shingle.
* a null doc_id takes part like any other; component_id is the least id that is not null, or null if there is
  none, and ``kept`` says whether the two agree. ``keep`` goes by rows: of each group one row stays, that of the
  least id, null ids last.
* rows that repeat a doc_id with the same text get equal results, and ``keep`` takes one; rows that repeat it with
  another text are documents of their own.
* very long texts are sketched whole; ties of equal sets go to the least id; an empty table stays empty;
  other columns are ignored by ``components`` and pass through ``keep``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import words
from millrace.session import cut, fresh

SHINGLE = 5
BINS = 125
PERCENT = 85  # the contract of op1; other callers name their threshold
MISS = 1e-6
SMALL = 1 << 20  # narrow rows that may be broadcast: up to 40 MB
HOT = 1000  # members from which a bucket's rows are not gathered in one task
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 20


def band_rows(percent: int) -> int:
    """The most coordinates a band can have for two sets at the threshold to miss all bands at most ``MISS`` of the time."""
    return max(r for r in range(1, BINS + 1) if r == 1 or (1 - (percent / 100) ** r) ** (BINS // r) <= MISS)


def least_agreement(percent: int) -> int:
    """The bins in which the sketches of two sets at the threshold agree, less 6.5 standard errors."""
    p = percent / 100
    return max(0, int(BINS * p - 6.5 * (BINS * p * (1 - p)) ** 0.5))


def shingle_sets(texts: list[bytes], memo: words.Memo, k: int = SHINGLE) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    split = [words.split(t.lower()) for t in texts]
    off = words.offsets(map(len, split))
    h = np.fromiter((memo[w] for ws in split for w in ws), np.uint64, int(off[-1]))
    hashed, _, n = words.windows(h, off, k)
    ends = words.offsets(n)
    out = []
    for i, ws in enumerate(split):
        if n[i]:
            out.append(np.unique(hashed[ends[i] : ends[i + 1]]))
        elif ws:
            out.append(words.windows(h[off[i] : off[i + 1]] + np.uint64(len(ws)), np.array([0, len(ws)]), len(ws))[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """The sketch of each non-empty set; rows of empty sets hold the greatest value throughout."""
    out = np.full((len(sets), bins), np.iinfo(np.uint64).max, np.uint64)
    flat = out.ravel()
    sizes = np.array([len(s) for s in sets])
    live = np.flatnonzero(sizes)
    x = np.concatenate([sets[i] for i in live]) if len(live) else np.zeros(0, np.uint64)
    doc = np.repeat(live, sizes[live])
    for i in range(2 * bins):
        if not len(x):
            break
        h = words.mix(x + words.step(i + 1))
        bin_ = (h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32) if i < bins else np.full(len(x), i - bins, np.uint64)
        value = np.uint64(i) << np.uint64(56) | words.mix(h) >> np.uint64(8)
        np.minimum.at(flat, doc * bins + bin_.astype(np.int64), value)
        open_ = (out[live] == np.iinfo(np.uint64).max).any(1)
        if not open_.all():
            live = live[open_]
            still = np.zeros(len(sets), bool)
            still[live] = True
            x, doc = x[still[doc]], doc[still[doc]]
    return out


def band_keys(sketches: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit bucket key per band; bands never share keys but by chance."""
    bands = sketches.shape[1] // rows
    parts = words.mix(sketches[:, : bands * rows]).reshape(len(sketches), bands, rows)
    total = np.zeros(parts.shape[:2], np.uint64)
    for j in range(rows):
        total = words.mix(total + parts[:, :, j])
    return words.mix(total + np.arange(parts.shape[1], dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).astype(np.int64)


def _sketched(docs: DataFrame, percent: int) -> DataFrame:
    band = band_rows(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = words.hash_memo()
        for batch, texts in words.text_batches(batches, max_bytes=2 << 20):
            sets = shingle_sets(texts, memo)
            rows = sketch(sets)
            keys = band_keys(rows, band)
            prints = np.array([(words.mix(s).sum(), words.mix(s + np.uint64(0xA0761D6478BD642F)).sum()) for s in sets], np.uint64).reshape(-1, 2).astype(np.int64)
            short = words.mix(rows).astype(np.uint8)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), bands, pa.array([r.tobytes() for r in short], pa.binary())],
                names=["doc_id", "text_key", "n_shingles", "print_a", "print_b", "bands", "short"],
            )
        memo.clear()
        words.release()

    schema = "doc_id long, text_key long, n_shingles long, print_a long, print_b long, bands array<long>, short binary"
    return _named(docs).mapInArrow(run, schema)


def _named(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text): a row is known by the first two."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return (a["text_key"] == b["text_key"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def _few(df: DataFrame) -> DataFrame:
    """The rows, computed once; broadcast if they are few enough."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= SMALL else df


def _by_bucket(rows: DataFrame, side: DataFrame) -> DataFrame:
    """``rows`` joined on ``key`` to ``side``, one row (key, members, ..) a bucket. Buckets of many members go by broadcast:
    they have ``HOT`` members or more, and so many that there are at most ``SMALL`` of them."""
    side = cut(side)
    total = side.agg(F.sum("members")).first()[0] or 0
    least = max(HOT, -(-total // SMALL))
    hot = F.broadcast(side.where(F.col("members") >= least))
    cold = rows.join(F.broadcast(side.where(F.col("members") >= least).select("key")), "key", "left_anti")
    return rows.join(hot, "key").unionByName(cold.join(side.where(F.col("members") < least), "key")).drop("members")


def _hashed_sets(docs: DataFrame) -> DataFrame:
    """(node, hashes) of rows (node, print_a, text) whose text has that fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = words.hash_memo()
        for batch, texts in words.text_batches(batches):
            sets = shingle_sets(texts, memo)
            prints = np.array([words.mix(s).sum() for s in sets], np.uint64).view(np.int64)
            right = pa.array(prints == batch.column("print_a").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("node").filter(right), pa.array([s.tobytes() for s in sets], pa.binary()).filter(right)], names=["node", "hashes"])
        memo.clear()
        words.release()

    return docs.mapInArrow(run, "node long, hashes binary")


def _similar(common: np.ndarray | int, n: np.ndarray | int, m: np.ndarray | int, percent: int) -> np.ndarray | bool:
    return 100 * common >= percent * (n + m - common)


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """The components of pairs whose full sets, in ``set_a`` and ``set_b``, are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                ok.append(_similar(len(p) + len(q) - len(np.union1d(p, q)), len(p), len(q), percent))
            yield batch.select(["ca", "cb"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("ca", "cb", "set_a", "set_b").mapInArrow(run, "ca long, cb long")


def _likely(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sketches agree in enough bins."""
    agree = least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p, q = (np.stack([np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(c)]) for c in ("short_a", "short_b"))
                yield batch.select(["a", "b"]).filter(pa.array((p == q).sum(1) >= agree))

    return pairs.select("a", "b", "short_a", "short_b").mapInArrow(run, "a long, b long")


def _with_partner(blocks: DataFrame, percent: int) -> DataFrame:
    """The members of buckets that have a likely partner of another component in their block."""
    agree = least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start in words.groups(batches, ("key", "i", "j")):
            short = np.frombuffer(b"".join(x.as_buffer() for x in t.column("short").combine_chunks()), np.uint8).reshape(-1, BINS)
            comp, n, side = (t.column(c).to_numpy() for c in ("comp", "n_shingles", "side"))
            within_one = t.column("i").to_numpy() == t.column("j").to_numpy()
            group = np.repeat(np.arange(len(start) - 1), np.diff(start))
            hit = np.zeros(t.num_rows, bool)
            for gap in range(1, int(np.diff(start).max())):
                x = np.flatnonzero(group[gap:] == group[:-gap])
                y = x + gap
                fit = (comp[x] != comp[y]) & (within_one[x] | (side[x] != side[y])) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
                x, y = x[fit], y[fit]
                ok = (short[x] == short[y]).sum(1) >= agree
                hit[x[ok]] = hit[y[ok]] = True
            yield pa.RecordBatch.from_arrays([t.column(c).combine_chunks().filter(pa.array(hit)) for c in ("key", "node", "comp", "n_shingles")], names=["key", "node", "comp", "n_shingles"])

    return blocks.mapInArrow(run, "key long, node long, comp long, n_shingles long")


def _spanning(blocks: DataFrame, percent: int) -> DataFrame:
    """Links (ca, cb) enough to join all components with similar members in one block, from the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start in words.groups(batches, ("key", "i", "j")):
            comp, side = t.column("comp").to_numpy(), t.column("side").to_numpy()
            one = t.column("i").to_numpy() == t.column("j").to_numpy()
            sets = t.column("hashes").combine_chunks()
            found = []
            for a, b in zip(start[:-1], start[1:], strict=True):
                own = [np.frombuffer(sets[k].as_buffer(), np.uint64) for k in range(a, b)]
                found += _tree(own, comp[a:b], side[a:b], bool(one[a]), percent)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["ca", "cb"])

    return blocks.mapInArrow(run, "ca long, cb long")


def _tree(sets: list[np.ndarray], comp: np.ndarray, side: np.ndarray, one: bool, percent: int, columns: int = 4096) -> list[tuple[int, int]]:
    """A spanning forest, over components, of the similar pairs of a block; between its two sides if it has two."""
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    place = np.cumsum(count > 1) - 1
    row, column = row[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        lo, hi = np.searchsorted(column, (c, c + columns))
        part = np.zeros((len(sets), columns), np.float32)
        part[row[lo:hi], column[lo:hi] - c] = 1
        common += part @ part.T
    similar = _similar(common, size[:, None], size[None, :], percent) & (comp[:, None] != comp[None, :])
    if not one:
        similar &= side[:, None] != side[None, :]
    up = {c: c for c in comp.tolist()}

    def top(c: int) -> int:
        while up[c] != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    out = []
    for x, y in zip(*np.nonzero(np.triu(similar)), strict=True):
        p, q = top(int(comp[x])), top(int(comp[y]))
        if p != q:
            up[p] = q
            out.append((int(comp[x]), int(comp[y])))
    return out


def contract(links: DataFrame) -> DataFrame | None:
    """(comp, into) for every component that a link (ca, cb) joins to others; None without links.

    Each round every component takes the member of its closed neighbourhood with the least hash; links
    between different takers remain. Hashes make chains shrink by a constant factor a round.
    """
    links, maps = cut(links.where("ca != cb").select(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).distinct()), None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("cb").alias("ca"), F.col("ca").alias("cb")))
        key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("c"))
        step = cut(both.groupBy("ca").agg(F.min(key("cb")).alias("m")).select(F.col("ca").alias("comp"), F.least("m", key("ca"))["c"].alias("into")))
        if maps is None:
            maps = step
        else:
            on = step.select(F.col("comp").alias("into"), F.col("into").alias("_next"))
            maps = cut(maps.join(on, "into", "left").select("comp", F.coalesce("_next", "into").alias("into")))
        a = step.select(F.col("comp").alias("ca"), F.col("into").alias("na"))
        b = step.select(F.col("comp").alias("cb"), F.col("into").alias("nb"))
        moved = links.join(a, "ca").join(b, "cb").where("na != nb")
        links = cut(moved.select(F.least("na", "nb").alias("ca"), F.greatest("na", "nb").alias("cb")).distinct())
    return maps


def _blocks(members: DataFrame, weight: Column, limit: int) -> DataFrame:
    """Each bucket's members in blocks of about ``limit`` of ``weight``, dealt to every pair (i, j) of blocks that
    can hold members of two components.

    A component of ``limit`` or more has blocks of its own, which never meet each other; smaller ones share blocks,
    whole. Buckets of one block, nearly all, are copied once; a member meets others in tasks of bounded size.
    """
    per = members.groupBy("key", "comp").agg(F.sum(weight).alias("w")).withColumn("big", F.col("w") >= limit)
    shared = per.where("NOT big").groupBy("key").agg(F.ceil(F.sum("w") / limit).alias("parts"))
    # Buckets with many components have as many rows here: what is known of a bucket goes to them, not they to it.
    per = per.join(_few(shared), "key", "left").withColumn("parts", F.when(F.col("big"), F.ceil(F.col("w") / limit)).otherwise(F.col("parts")))
    per = cut(per.select("key", "comp", "big", "parts"))
    owner, block = F.when(F.col("big"), F.col("comp")), F.xxhash64("big", "owner", "part")
    labels = per.select("key", "big", owner.alias("owner"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).distinct()
    labels = labels.select("key", "owner", block.alias("b"))
    i, j = labels.select("key", F.col("owner").alias("oi"), F.col("b").alias("i")), labels.select("key", F.col("owner").alias("oj"), F.col("b").alias("j"))
    pairs = i.join(j, "key").where("i <= j AND (oi IS NULL OR oj IS NULL OR oi != oj)").select("key", "i", "j")
    sides = pairs.select("key", "i", "j", F.col("i").alias("b"), F.lit(0).alias("side")).unionByName(pairs.where("i != j").select("key", "i", "j", F.col("j").alias("b"), F.lit(1).alias("side")))
    part = F.pmod(F.xxhash64(F.when(F.col("big"), F.col("node")).otherwise(F.col("comp"))), F.col("parts"))
    of = members.join(_few(per), ["key", "comp"]).withColumn("part", part).withColumn("owner", owner)
    dealt = of.select(*members.columns, block.alias("b")).join(_few(sides), ["key", "b"]).drop("b")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, hashes) of the wanted nodes. Up to ``SMALL`` of them go to the texts; beyond, both are joined by a shuffle."""
    rows = _few(nodes.join(wanted.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "text_key", "print_a"))
    named = _named(docs)
    texts = named.join(rows, _same_row(named, rows)).select("node", "print_a", "text")
    return cut(_hashed_sets(texts.dropDuplicates(["node"])))


def _judged(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sketched rows (checkpointed), and of each fingerprint (print_a, print_b, n_shingles): the least id of its
    component, and the row of that component that stays."""
    rows = cut(_sketched(docs, percent))
    held = rows.where("n_shingles > 0")
    same = ["print_a", "print_b", "n_shingles"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    nodes = held.groupBy(*same).agg(first.alias("row"), F.first("bands").alias("bands"), F.first("short").alias("short"))
    # Numbers are unique whatever the partitions, and the checkpoint fixes them.
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("node"), *same, "row", "row.doc_id", "row.text_key", "bands", "short"))
    comps = _link(docs, nodes, percent)
    named = nodes.select("node", *same, "row")
    if comps is None:
        return rows, named.select(*same, "row")
    of = named.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    # Only nodes that share a bucket can be in a component with others.
    least = of.groupBy("comp").agg(F.min("row").alias("row"))
    return rows, of.drop("row").join(least, "comp").select(*same, "row")


def components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept. Pairs of ``percent`` similarity or more are linked."""
    rows, named = _judged(docs, percent)
    same = ["print_a", "print_b", "n_shingles"]
    held = rows.where("n_shingles > 0").select("doc_id", *same).join(named.select(*same, F.col("row.doc_id").alias("component_id")), same, "left")
    bare = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    found = held.select("doc_id", "n_shingles", "component_id").unionByName(bare)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; a row that repeats another's id and text goes.

    Only ids and hashes move: the few rows that go, or that occur more than once, meet the texts by a broadcast up to
    ``SMALL`` of them, beyond that by a shuffle.
    """
    rows, named = _judged(docs, percent)
    same = ["print_a", "print_b", "n_shingles"]
    each = rows.where("n_shingles > 0").groupBy("doc_id", "text_key", *same).agg(F.sum(F.lit(1)).alias("n"))
    each = each.join(named, same).withColumn("stays", F.col("doc_id").eqNullSafe(F.col("row.doc_id")) & (F.col("text_key") == F.col("row.text_key")))
    odd = cut(each.where("NOT stays OR n > 1").select("doc_id", "text_key", "stays"))
    small = odd.count() <= SMALL
    gone, again = (F.broadcast(x) if small else x for x in (odd.where("NOT stays"), odd.where("stays")))
    key = fresh(docs, "text_key")
    whole = docs.withColumn(key, F.xxhash64("text"))
    on = lambda left, right: (left[key] == right["text_key"]) & left["doc_id"].cast("long").eqNullSafe(right["doc_id"])
    left = whole.join(gone, on(whole, gone), "left_anti")
    if odd.where("stays").isEmpty():
        return left.drop(key)
    once = left.join(again, on(left, again), "left_semi").dropDuplicates([key, "doc_id"])
    return left.join(again, on(left, again), "left_anti").unionByName(once).drop(key)


def _link(docs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame | None:
    """(node, comp) of the nodes in shared buckets, once no pair in a bucket could join two components."""
    rows = nodes.select("node", "n_shingles", F.explode("bands").alias("key"))
    by_hash = F.min_by("node", F.xxhash64("node"))
    shared = rows.groupBy("key").agg(F.sum(F.lit(1)).alias("members"), F.min("node").alias("first"), by_hash.alias("second")).where("members > 1")
    rows = cut(_by_bucket(rows, shared))
    if rows.isEmpty():
        return None
    short = nodes.select("node", "short", "n_shingles")

    # Seeds: each node with the least node it shares a bucket with, by number and by hash.
    ahead = rows.groupBy("node").agg(F.min("first").alias("first"), F.min_by("second", F.xxhash64("second")).alias("second"))
    seeds = ahead.select(F.col("node").alias("b"), F.explode(F.array("first", "second")).alias("a")).where("a != b").distinct()
    left = short.select(F.col("node").alias("a"), F.col("short").alias("short_a"))
    right = short.select(F.col("node").alias("b"), F.col("short").alias("short_b"))
    likely = cut(_likely(seeds.join(left, "a").join(right, "b"), percent))
    sets = _sets_of(docs, nodes, likely.select(F.explode(F.array("a", "b")).alias("node")))
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("set_b"))
    pairs = likely.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")).join(right, "b").join(left, "a")
    comps = rows.select("node").distinct().withColumn("comp", F.col("node"))
    comps = _moved(comps, contract(_confirmed(pairs, percent)))

    # The rest: buckets that still hold several components are compared whole, in bounded blocks.
    member = rows.select("key", "node", "n_shingles").join(comps, "node")
    mixed = member.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum(F.lit(1)).alias("members")).where("lo != hi").select("key", "members")
    member = cut(_by_bucket(member, mixed).join(short.select("node", "short"), "node"))
    open_ = cut(_with_partner(_blocks(member, F.lit(1), BLOCK_ROWS), percent).distinct())
    more = _sets_of(docs, nodes, open_)
    weight = F.greatest(F.col("n_shingles"), F.lit(BLOCK_SHINGLES // BLOCK_ROWS))  # bounds rows as well as shingles
    links = _spanning(_blocks(open_.join(more, "node"), weight, BLOCK_SHINGLES), percent)
    return _moved(comps, contract(links))


def _moved(comps: DataFrame, into: DataFrame | None) -> DataFrame:
    return comps if into is None else cut(comps.join(into, "comp", "left").select("node", F.coalesce("into", "comp").alias("comp")))
