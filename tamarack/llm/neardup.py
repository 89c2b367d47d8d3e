"""Problem 5: near-duplicate records by a chosen-path join.

A record is the set of its runs of three plain tokens. Records with the same set are one
class, named by the set's hash; a class stands once in a bucket. A run of the join gives every path (a sequence of tokens
of the sets) a hash function; a set x follows the tokens whose value is below
1 / (LAMBDA |x|), so 1 / LAMBDA of them on the average, so similar sets share paths and others rarely do.
Splitting goes on until the bucket is small: the frequencies of the path's tokens
bound it. These come from a count-min sketch, the same for all records, so that
any two records stop on the same path; it never counts too little, and a path whose
rarest token is in one record only is left out, as it holds no pair. Tokens that always go together (a stock paragraph) mislead
that estimate, so buckets are counted, too, on a sample of the sets: what is crowded there is split on.

Runs are repeated with other hash functions until the target recall: how many pairs were met in one run only, and in two,
tells how many were met in none (Chao's estimate).

The members of a bucket are compared by a sketch of 128 bits (one bit of 128 min-hashes) and
their sizes, and what is left by the sets themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import plain_tokens
from tamarack.session import cut_lineage

LIMIT = 0.5
LEAST_WORDS, SHINGLE = 20, 3
RECALL, RUNS, MORE, MOST_RUNS = 0.999, 8, 4, 32  # runs at first, and in each further round
LAMBDA, DEPTH = 0.6, 12
SMALL, EXPECTED = 24, 20.0  # a bucket is small if the rarest token is in so few sets, or so many sets are expected
TOGETHER = 0.75  # tokens of a text go together: a further one divides a bucket by less than its frequency says
SAMPLED, CROWDED, ROUNDS = (5_000, 200_000), 16, DEPTH  # sets in the sample at least and at most; so many of it in a bucket are a crowd
SKETCH_ROWS, SKETCH_BITS = 2, (16, 23)  # slots of a row, by the number of tokens: a byte each
AGREE = 83  # of 128 bits: 96 are expected at the limit (less than 0.3 % have fewer), 66 for strangers
MARK_BITS = (16, 27)  # of the bitmap of wanted sets, by their number
SEED = 11

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_TOKENS: dict[str, int] = {}


def _token(token: str) -> int:
    found = _TOKENS.get(token)
    if found is None:
        import xxhash

        if len(_TOKENS) > 300_000:
            _TOKENS.clear()
        found = _TOKENS[token] = xxhash.xxh64_intdigest(token)
    return found


def shingles(text: str) -> np.ndarray:
    """The distinct runs of three plain tokens, as sorted 32-bit numbers."""
    tokens = plain_tokens(text, digits=True)
    n = len(tokens) - SHINGLE + 1
    if n < 1:
        return np.empty(0, np.int32)
    h = np.fromiter(map(_token, tokens), np.uint64, len(tokens))
    run = h[:n]
    for i in range(1, SHINGLE):
        run = _mixed(run * np.uint64(3)) + h[i : i + n]
    return np.unique((_mixed(run) >> np.uint64(32)).astype(np.uint32).view(np.int32))


def _sets(texts: DataFrame) -> DataFrame:
    """(``id``, ``sig``, ``s``) of the texts of enough words that have a run of three tokens."""

    def run(batches):
        import xxhash

        for batch in batches:
            ids, sigs, sets = [], [], []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                if i is None or text is None or len(text.split()) < LEAST_WORDS:
                    continue
                s = shingles(text)
                if len(s):
                    ids.append(i), sets.append(s), sigs.append(xxhash.xxh64_intdigest(s.tobytes()))
            sizes = np.fromiter(map(len, sets), np.int32, len(sets))
            flat = np.concatenate(sets) if sets else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(np.array(sigs, np.uint64).view(np.int64)), lists], ["id", "sig", "s"])

    return texts.select(F.col("id").cast("string").alias("id"), "text").mapInArrow(run, "id string, sig long, s array<int>")


#: What a byte of the sketch stands for: exact to 64, then in steps of an eighth of a power of two.
_VALUES = np.r_[np.arange(65), np.ceil(64 * 2.0 ** (np.arange(1, 191) / 8))].astype(np.int64)
_BLOCK = 4096


def _bits(n: int, bounds: tuple[int, int]) -> int:
    return min(max(int(n).bit_length(), bounds[0]), bounds[1])


def _slots(tokens: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (_mixed(tokens.astype(np.uint32).astype(np.uint64) + np.uint64(1000003 * (row + 1))) >> np.uint64(64 - bits)).astype(np.int64)


class Sketch:
    """A count-min sketch: SKETCH_ROWS x 2^bits bytes, rounded up, so it never says too little."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes, self.bits = codes, bits

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        return _VALUES[np.minimum.reduce([self.codes[r][_slots(tokens, r, self.bits)] for r in range(SKETCH_ROWS)])]


def _blocks(slots: DataFrame, total: int, value: str) -> np.ndarray:
    """Bytes of ``value`` by ``slot`` as one array: what comes to the driver is ``total`` bytes, whatever is in them."""

    def pack(group: pa.Table) -> pa.Table:
        at = group.column("slot").to_numpy() % _BLOCK
        out = np.zeros(_BLOCK, np.uint8)
        out[at] = group.column(value).to_numpy()
        return pa.table({"block": group.column("block").slice(0, 1), "bytes": pa.array([out.tobytes()], pa.binary())})

    packed = slots.withColumn("block", F.floor(F.col("slot") / _BLOCK).cast("int")).select("block", "slot", value).groupBy("block").applyInArrow(pack, "block int, bytes binary").toArrow()
    out = np.zeros((-(-total // _BLOCK), _BLOCK), np.uint8)
    for block, data in zip(packed.column("block").to_pylist(), packed.column("bytes").to_pylist()):
        out[block] = np.frombuffer(data, np.uint8)
    return out.ravel()[:total]


def _frequencies(sets: DataFrame, tokens: int) -> Sketch:
    """In how many rows each token is, by slot; ``tokens``: how many there are in all."""
    bits = _bits(tokens // 8, SKETCH_BITS)

    def run(batches):
        total = np.zeros((SKETCH_ROWS, 1 << bits), np.int64)
        for batch in batches:
            found = batch.column("s").flatten().to_numpy(zero_copy_only=False)
            for r in range(SKETCH_ROWS):
                total[r] += np.bincount(_slots(found, r, bits), minlength=1 << bits)
        flat = total.ravel()
        at = np.flatnonzero(flat)
        for lo in range(0, len(at), 100_000):
            part = at[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(flat[part])], ["slot", "n"])

    sums = sets.select("s").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    above = F.least(F.ceil(F.log2(F.col("n") / 64) * 8), F.lit(190)) + 64
    codes = sums.select("slot", F.when(F.col("n") <= 64, F.col("n")).otherwise(above).cast("int").alias("code"))
    return Sketch(_blocks(codes, SKETCH_ROWS << bits, "code").reshape(SKETCH_ROWS, -1), bits)


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    total = int(length.sum())
    first = np.cumsum(length) - length
    return np.arange(total) - np.repeat(first, length) + np.repeat(start, length)


def follow(tokens: np.ndarray, sizes: np.ndarray, frequency: np.ndarray, n: int, run: int, crowded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) of the buckets that the sets of a batch reach in a run.

    ``tokens``: the sets one after the other; ``frequency``: of each token; ``n``: of all sets; ``crowded``: the paths
    that aren't small, in ascending order.
    """
    start = np.cumsum(sizes) - sizes
    below = (2.0**64 / (LAMBDA * np.maximum(sizes, 1 / LAMBDA))).clip(max=2.0**64 - 2048).astype(np.uint64)
    wide = tokens.astype(np.uint32).astype(np.uint64)
    row = np.arange(len(sizes))
    path = np.full(len(sizes), np.uint64(SEED + 7919 * run), np.uint64)
    least = np.full(len(sizes), n, np.int64)
    expected = np.full(len(sizes), float(n))
    rows, paths = [], []
    for depth in range(DEPTH):
        at = _ranges(start[row], sizes[row])
        parent = np.repeat(np.arange(len(row)), sizes[row])
        value = _mixed(wide[at] * np.uint64(0x9E3779B97F4A7C15) ^ path[parent])
        chosen = np.flatnonzero(value < below[row[parent]])
        at, parent, value = at[chosen], parent[chosen], value[chosen]
        seen = frequency[at]
        shared = seen > 1
        at, parent, value, seen = at[shared], parent[shared], value[shared], seen[shared]
        path = _mixed(path[parent] * np.uint64(31) + value)
        row = row[parent]
        least = np.minimum(least[parent], seen)
        expected = expected[parent] * np.minimum(seen / n, 1.0) ** (1.0 if depth == 0 else TOGETHER)
        done = (least <= SMALL) | (expected < EXPECTED)
        if len(crowded):
            done &= crowded[np.searchsorted(crowded, path).clip(max=len(crowded) - 1)] != path
        if depth == DEPTH - 1:
            done[:] = True
        rows.append(row[done])
        paths.append(path[done])
        row, path, least, expected = row[~done], path[~done], least[~done], expected[~done]
        if not len(row):
            break
    return np.concatenate(rows), np.concatenate(paths)


def _sketch(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128 bits a set, as two 64-bit numbers: one bit of each of 128 min-hashes."""
    rng = np.random.default_rng(SEED)
    factors = rng.integers(1, 2**63, 128, dtype=np.uint64) | np.uint64(1)
    base = _mixed(tokens.astype(np.uint32).astype(np.uint64) + np.uint64(77))
    start = np.cumsum(sizes) - sizes
    out = np.zeros((len(sizes), 2), np.uint64)
    for i, f in enumerate(factors):
        least = np.minimum.reduceat(base * f, start)
        bit = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)
        out[:, i // 64] |= bit << np.uint64(i % 64)
    return out.view(np.int64)


class _Plan:
    """What the runs share: the sketch, the number of sets, the crowded paths."""

    def __init__(self, sketch: Sketch, n: int):
        self.sketch, self.n, self.crowded = sketch, max(n, 1), np.empty(0, np.uint64)

    def paths(self, lists: pa.ListArray, runs: range):
        tokens = lists.flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        frequency = self.sketch(tokens)
        found = [follow(tokens, sizes, frequency, self.n, r, self.crowded) for r in runs]
        run = np.repeat(np.array(runs, np.uint8), [len(row) for row, _ in found])
        row, path = (np.concatenate(x) for x in zip(*found))
        _, once = np.unique(path * np.uint64(0x9E3779B97F4A7C15) + row.astype(np.uint64), return_index=True)
        return tokens, sizes, row[once], path[once], run[once]


def _find_crowded(sets: DataFrame, plan: _Plan, runs: range) -> None:
    """Adds the paths of ``runs`` that hold a crowd to ``plan``: on a sample of bounded size, again below those found."""
    most = min(max(SAMPLED[0], plan.n // 16), SAMPLED[1])
    some = sets.where(F.pmod(F.xxhash64("sig"), F.lit(1 << 30)) < int(min(1.0, most / plan.n) * (1 << 30))).dropDuplicates(["sig"]).select("s")
    context = sets.sparkSession.sparkContext
    for _ in range(ROUNDS):
        shared = context.broadcast(plan)

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    path = shared.value.paths(batch.column("s"), runs)[3]
                    yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64))], ["path"])

        counts = some.mapInArrow(run, "path long").groupBy("path").count().where(F.col("count") >= CROWDED)
        got = counts.select("path").toArrow().column("path").to_numpy()  # at most the sample's paths / CROWDED
        if not len(got):
            return
        plan.crowded = np.union1d(plan.crowded, got.view(np.uint64))


def _buckets(sets: DataFrame, plan: _Plan, runs: range) -> DataFrame:
    """(``path``, ``run``, ``sig``, ``k``, ``b0``, ``b1``): a row for each bucket a set is in."""
    shared = sets.sparkSession.sparkContext.broadcast(plan)  # at most 2^24 bytes, and the crowded paths

    def run(batches):
        for batch in batches:
            # of copies in a batch one is enough; the others go after the shuffle
            _, once = np.unique(batch.column("sig").to_numpy(), return_index=True)
            batch = batch.take(pa.array(np.sort(once)))
            if not batch.num_rows:
                continue
            tokens, sizes, row, path, runs_ = shared.value.paths(batch.column("s"), runs)
            bits = _sketch(tokens, sizes)
            sig = batch.column("sig").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(runs_.astype(np.int8)), pa.array(sig[row]), pa.array(sizes[row].astype(np.int32)), pa.array(bits[row, 0]), pa.array(bits[row, 1])], ["path", "run", "sig", "k", "b0", "b1"])

    return sets.select("sig", "s").mapInArrow(run, "path long, run tinyint, sig long, k int, b0 long, b1 long")


def _marked(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose ``sig`` may be wanted: a bitmap, of eight bits for each wanted one, spares most others the shuffle."""
    size = 1 << _bits(wanted.count() * 8, MARK_BITS)
    slot = F.pmod(F.xxhash64("sig"), F.lit(size)).cast("int")
    bits = wanted.select(slot.alias("bit")).distinct().groupBy(F.floor(F.col("bit") / 8).cast("int").alias("slot")).agg(F.sum(F.call_function("shiftright", F.lit(128), F.col("bit") % 8)).cast("int").alias("byte"))
    shared = sets.sparkSession.sparkContext.broadcast(_blocks(bits, size // 8, "byte"))  # at most 2^24 bytes

    def run(batches):
        marks = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(marks[batch.column("slot").to_numpy()]))
            yield batch.select(["sig", "s"])

    return sets.select("sig", "s", slot.alias("slot")).mapInArrow(run, "sig long, s array<int>")


def _similarity(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def _met(sets: DataFrame, plan: _Plan, runs: range, limit: float) -> DataFrame:
    """(``sig_a``, ``sig_b``, ``runs``), ``sig_a`` < ``sig_b``: sets with a similarity of ``limit`` or more, and the runs they met in, as bits."""
    _find_crowded(sets, plan, runs)
    buckets = _buckets(sets, plan, runs)
    # by path first, so that what drops copies and what joins needs no other shuffle
    buckets = buckets.repartition("path").dropDuplicates(["path", "sig"])
    # the same columns on both sides, so that one shuffle serves both
    left = buckets.select("path", *(F.col(c).alias(f"{c}_a") for c in ("run", "sig", "k", "b0", "b1")))
    right = buckets.select("path", *(F.col(c).alias(f"{c}_b") for c in ("run", "sig", "k", "b0", "b1")))
    differ = F.bit_count(F.col("b0_a").bitwiseXOR(F.col("b0_b"))) + F.bit_count(F.col("b1_a").bitwiseXOR(F.col("b1_b")))
    near = (F.col("sig_a") < F.col("sig_b")) & (F.least("k_a", "k_b") >= limit * F.greatest("k_a", "k_b")) & (differ <= 128 - AGREE)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest("run_a", "run_b").cast("int"))
    pairs = left.join(right, "path").where(near).groupBy("sig_a", "sig_b").agg(F.bit_or(bit).alias("runs"))
    pairs = cut_lineage(pairs, "neardup-candidates")
    wanted = pairs.select(F.col("sig_a").alias("sig")).union(pairs.select("sig_b")).distinct()
    # equal sets are equal arrays: any of them stands for the class
    kept = _marked(sets, wanted).groupBy("sig").agg(F.first("s").alias("s")).join(wanted, "sig", "left_semi")
    pairs = pairs.join(kept.select(F.col("sig").alias("sig_a"), F.col("s").alias("s_a")), "sig_a").join(kept.select(F.col("sig").alias("sig_b"), F.col("s").alias("s_b")), "sig_b")
    return pairs.where(_similarity(F.col("s_a"), F.col("s_b")) >= limit).select("sig_a", "sig_b", "runs")


def estimated_recall(n: int, once: int, twice: int, runs: int) -> float:
    """The share of all pairs that was met, of which ``once`` in one run only and ``twice`` in two (Chao's lower bound of the unmet)."""
    unmet = (runs - 1) / runs * once * (once - 1) / (2 * (twice + 1))
    return n / (n + unmet) if n else 1.0


def similar_sets(sets: DataFrame, limit: float = LIMIT, recall: float = RECALL, report: dict | None = None) -> DataFrame:
    """(``sig_a``, ``sig_b``), ``sig_a`` < ``sig_b``: sets with a similarity of ``limit`` or more.

    ``sets``: ``sig``, ``s``; a set may come several times. Runs are repeated until ``recall`` is reached by estimate, at most
    MOST_RUNS; ``report`` takes ``runs`` and ``recall``.
    """
    n, tokens = sets.agg(F.count(F.lit(1)), F.sum(F.size("s"))).first()
    plan = _Plan(_frequencies(sets, tokens or 0), n)
    found, done, more = None, 0, RUNS
    while True:
        now = _met(sets, plan, range(done, done + more), limit)
        if found is not None:
            now = found.unionByName(now).groupBy("sig_a", "sig_b").agg(F.bit_or("runs").alias("runs"))
        found, done, more = cut_lineage(now, "neardup-links"), done + more, MORE
        times = F.bit_count("runs")
        met, once, twice = found.agg(F.count(F.lit(1)), F.count(F.when(times == 1, 1)), F.count(F.when(times == 2, 1))).first()
        reached = estimated_recall(met, once, twice, done)
        if report is not None:
            report |= {"runs": done, "recall": reached}
        if reached >= recall or done + more > MOST_RUNS:
            return found.select("sig_a", "sig_b")


def classes_and_links(texts: DataFrame, limit: float = LIMIT, recall: float = RECALL, report: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(``id``, ``sig``) of all records that count, and (``sig_a``, ``sig_b``) between classes.

    ``texts``: ``id`` (unique), ``text``; more columns are ignored. Null ids and texts, and
    texts of fewer than 20 words or three plain tokens, are in no class.
    """
    rows = cut_lineage(_sets(texts), "neardup-sets")
    return rows.select("id", "sig"), similar_sets(rows, limit, recall, report)


def pairs(texts: DataFrame, limit: float = LIMIT, recall: float = RECALL, report: dict | None = None) -> DataFrame:
    """(``id_a``, ``id_b``), ``id_a`` < ``id_b``: records with a similarity of ``limit`` or more, copies (equal sets) among them.

    All pairs of all members of similar classes, whatever their size. A class of n copies so gives n * (n - 1) / 2 rows:
    where copies are many, ``groups`` gives a row a record.
    """
    members, links = classes_and_links(texts, limit, recall, report)
    several = members.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sig")
    members = cut_lineage(members.join(several.withColumn("several", F.lit(True)), "sig", "left"), "neardup-members")
    copies = members.where("several").select("sig", "id")
    inside = copies.withColumnRenamed("id", "id_a").join(copies.withColumnRenamed("id", "id_b"), "sig").where("id_a < id_b").select("id_a", "id_b")
    across = links.join(members.select(F.col("sig").alias("sig_a"), F.col("id").alias("x")), "sig_a").join(members.select(F.col("sig").alias("sig_b"), F.col("id").alias("y")), "sig_b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return inside.unionByName(across)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(``node``, ``root``): for every node of a link the smallest node it is connected with.

    Each round every node takes the smallest root among its neighbours, then its root's
    root; rounds go on until nothing changes, each written to the shared folder.
    """
    both = cut_lineage(links.select(F.col(a).alias("x"), F.col(b).alias("y")).union(links.select(F.col(b), F.col(a))).distinct(), "neardup-links")
    roots = cut_lineage(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("x"), F.min("y")).alias("root")), "neardup-roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("y"), "root"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("least"))
        step = roots.join(near, "node").select("node", "root", F.least("root", "least").alias("least"))
        jump = step.join(step.select(F.col("node").alias("least"), F.col("least").alias("far")), "least")
        new = cut_lineage(jump.select("node", F.col("root").alias("old"), F.least("least", "far").alias("root")), "neardup-roots")
        if new.where("old <> root").isEmpty():
            return new.select("node", "root")
        roots = new.select("node", "root")


def groups(texts: DataFrame, limit: float = LIMIT, recall: float = RECALL) -> DataFrame:
    """(``id``, ``group``, ``n_links``): a row for each record that has near-duplicates.

    ``group`` is the smallest id of its connected records; ``n_links`` counts the similar
    classes (records of one class, copies, count as one).
    """
    members, links = classes_and_links(texts, limit, recall)
    root = components(links, "sig_a", "sig_b")
    degree = links.select(F.col("sig_a").alias("sig")).union(links.select("sig_b")).groupBy("sig").agg(F.count(F.lit(1)).alias("n_links"))
    rows = members.join(root.withColumnRenamed("node", "sig"), "sig", "left").join(degree, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    sizes = rows.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("group")).where("n > 1")
    return rows.join(sizes, "root").select("id", "group", F.coalesce("n_links", F.lit(0)).alias("n_links"))
