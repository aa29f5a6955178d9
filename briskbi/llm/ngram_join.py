"""N-gram Jaccard join: rare-first prefixes with length, positional and suffix filters.

A text's set holds its distinct ``n``-word shingles.  Two texts link when
100 * intersection >= percent * union.  The steps:

1. every distinct set sends its shingle hashes, packed by hash slice; a slice
   counts in how many sets a shingle occurs and returns the shared ones (two
   sets at least) to the sets.  Copies of a set count once.
2. a set orders its shingles rare-first (unshared ones lead, then by document
   frequency and hash).  Its prefix of n - ceil(t n) + 1 shingles must meet the
   prefix of any set it links with; sets with no shared shingle there, or with too few
   shared ones, leave here.
3. prefix shingles join.  The length filter, the suffix filter (shared shingles by hash
   range bound the intersection) and the positional filter thin the pairs; what is left
   is verified once by intersecting the sets.

Large groups of near copies would meet in all their pairs.  Only links *between*
components matter for components, so two rounds first verify each set against a
random partner from each of a few of its prefix lists.  What is left goes two ways: a set
outside the largest component of one of its lists is verified against that whole
component, block by block; sets outside the largest component, of different components,
join on their prefix shingles.  No link that could merge components is left out.

Defined cases: null or empty text, or one without words: empty set, linked with
nothing; fewer than ``n`` words: the whole sequence is the one shingle; rows with
equal sets (repeated rows too) share a component; null ids are kept, and are the
component's id only where all its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from briskbi.llm.shared import SLICE_BYTES, Tables, Words, components, cuts, keep, mix, rows_of, shingles, steps, text_slices

#: Shingles, and sets, a task gathers before it sends them on.
FLUSH, FLUSH_SETS = 1 << 20, 60_000
RANGES = 16
_LOW48 = np.uint64((1 << 48) - 1)
_PACKED = "part int, data binary"


class Sets:
    """Distinct shingles of each text of a batch, sorted, with a key of the whole set."""

    def __init__(self, col: pa.Array, n: int):
        words = Words(col, lower=True)
        counts = words.counts()
        of = np.repeat(np.arange(len(counts)), counts)
        grams = shingles(words.hashes, n)
        inside = of[: len(grams)] == of[n - 1 :] if len(grams) else np.zeros(0, bool)
        grams, of = grams[inside], of[: len(inside)][inside]
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):
            whole = [shingles(words.hashes[words.first[i] : words.first[i + 1]], int(counts[i])) for i in short]
            grams, of = np.concatenate([grams, *whole]), np.concatenate([of, short])
        order = np.lexsort((grams, of))
        grams, of = grams[order], of[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
        self.grams, self.of = grams[new], of[new]
        self.sizes = np.bincount(self.of, minlength=len(counts))
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.keys = np.zeros(len(counts), np.uint64)
        full = np.flatnonzero(self.sizes)
        if len(full):
            with np.errstate(over="ignore"):
                total = np.add.reduceat(mix(self.grams), self.first[:-1][full])
                self.keys[full] = mix(total + self.sizes[full].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _frequency_class(df: np.ndarray) -> np.ndarray:
    """Document frequency in a byte: exact below 128, then eight steps for each doubling."""
    high = 128 + np.floor(8 * np.log2(np.maximum(df, 128) / 128))
    return np.where(df < 128, df, np.minimum(high, 255)).astype(np.uint8)


def _pack(keys: np.ndarray, sizes: np.ndarray, at: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sets that occur, their sizes, and per entry the set's place and further columns."""
    used, at = np.unique(at, return_inverse=True)
    head = np.array([len(used), len(at)], np.uint32)
    return b"".join(x.tobytes() for x in (head, keys[used], sizes[used].astype(np.uint32), at.astype(np.uint32 if len(used) > 65535 else np.uint16), *columns))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(keys, sizes, place of each entry, where the further columns begin)."""
    m, e = (int(x) for x in np.frombuffer(blob, np.uint32, 2))
    kind = np.dtype(np.uint32 if m > 65535 else np.uint16)
    at = 8 + 12 * m
    return np.frombuffer(blob, np.uint64, m, 8), np.frombuffer(blob, np.uint32, m, 8 + 8 * m), np.frombuffer(blob, kind, e, at), at + kind.itemsize * e


def _six(x: np.ndarray) -> np.ndarray:
    """The low six bytes of each number."""
    return x.view(np.uint8).reshape(-1, 8)[:, :6]


def _eight(blob: bytes, at: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8, 6 * n, at).reshape(n, 6)
    return out.view(np.uint64).ravel()


def _senders(n: int, slices: int):
    """Task function on texts: packed shingles by hash slice, one copy of a set for each flush."""

    def send(grams: list, sizes: list, keys: list) -> pa.RecordBatch:
        g, k, s = np.concatenate(grams), np.concatenate(keys), np.concatenate(sizes)
        of = np.repeat(np.arange(len(k)), s)
        order = np.argsort(g, kind="stable")
        g, of = g[order], of[order]
        part = ((g >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)
        at = cuts(part)
        runs = [(int(part[a]), _pack(k, s, of[a:b], _six(g[a:b]))) for a, b in zip(at[:-1], at[1:], strict=True) if b > a]
        return rows_of(_PACKED, {"part": pa.array([p for p, _ in runs], pa.int32()), "data": pa.array([d for _, d in runs], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sizes, keys, seen, held = [], [], [], set(), 0
        for batch in steps(batches, "_text"):
            sets = Sets(batch.column(0), n)
            new = np.zeros(len(sets.sizes), bool)
            for i in np.flatnonzero(sets.sizes):
                key = int(sets.keys[i])
                if key not in seen:
                    seen.add(key)
                    new[i] = True
            grams.append(sets.grams[new[sets.of]])
            sizes.append(sets.sizes[new])
            keys.append(sets.keys[new])
            held += len(grams[-1])
            if held >= FLUSH or len(seen) >= FLUSH_SETS:
                yield send(grams, sizes, keys)
                grams, sizes, keys, seen, held = [], [], [], set(), 0
        if held:
            yield send(grams, sizes, keys)

    return run


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Rows sorted by part, all blobs of a part together."""
    now, blobs = None, []
    for batch in batches:
        for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if part != now and blobs:
                yield now, blobs
                blobs = []
            now = part
            blobs.append(data)
    if blobs:
        yield now, blobs


def _counters(slices: int, buckets: int):
    """Task function on slices: the shared shingles with their frequency, packed by set bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blobs in _by_part(batches):
            grams, keys, sizes = [], [], []
            for blob in blobs:
                k, s, at, rest = _unpack(blob)
                grams.append(_eight(blob, rest, len(at)))
                keys.append(k[at])
                sizes.append(s[at])
            g, k, s = np.concatenate(grams), np.concatenate(keys), np.concatenate(sizes)
            order = np.lexsort((k, g))
            g, k, s = g[order], k[order], s[order]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
            g, k, s = g[new], k[new], s[new]
            df = np.diff(cuts(g))
            df = np.repeat(df, df)
            shared = df > 1
            g, k, s, df = g[shared], k[shared], s[shared], _frequency_class(df[shared])
            with np.errstate(over="ignore"):
                g = mix(g + np.uint64(part) * np.uint64(0x9E3779B97F4A7C15)) & _LOW48
            bucket = np.mod(k.view(np.int64), buckets)
            order = np.argsort(bucket, kind="stable")
            g, k, s, df, bucket = g[order], k[order], s[order], df[order], bucket[order]
            at = cuts(bucket)
            parts, data = [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                if b > a:
                    own, first, place = np.unique(k[a:b], return_index=True, return_inverse=True)
                    parts.append(int(bucket[a]))
                    data.append(_pack(own, s[a:b][first], place, _six(g[a:b]), df[a:b]))
            if parts:
                yield rows_of(_PACKED, {"part": pa.array(parts, pa.int32()), "data": pa.array(data, pa.binary())})

    return run


_RECORD = "key long, n int, shared int, prefix binary, grams binary"


def _recorders(percent: int):
    """Task function on set buckets: sets that can have a link, with prefix and sorted shared shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _by_part(batches):
            grams, keys, sizes, dfs = [], [], [], []
            for blob in blobs:
                k, s, at, rest = _unpack(blob)
                grams.append(_eight(blob, rest, len(at)))
                dfs.append(np.frombuffer(blob, np.uint8, len(at), rest + 6 * len(at)))
                keys.append(k[at])
                sizes.append(s[at])
            g, k, s, df = (np.concatenate(x) for x in (grams, keys, sizes, dfs))
            order = np.lexsort((g, df, k))
            g, k, s = g[order], k[order], s[order].astype(np.int64)
            edge = cuts(k)
            first, shared = edge[:-1], np.diff(edge)
            n = s[first]
            least = -(-percent * n // 100)
            take = (n - least + 1) - (n - shared)
            rows = [(int(k[a].view(np.int64)), int(m), int(c), g[a : a + min(t, c)].tobytes(), np.sort(g[a : a + c]).tobytes()) for a, c, m, t, q in zip(first, shared, n, take, least, strict=True) if t > 0 and c >= q]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["key", "n", "shared", "prefix", "grams"])

    return run


def _postings(records: DataFrame) -> DataFrame:
    """(gram, key, n, pos, rank, s0..): one row per prefix shingle that others share."""
    schema = "gram long, key long, n int, pos int, rank int, " + ", ".join(f"s{i} int" for i in range(RANGES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                key, n, shared = (part.column(i).to_numpy() for i in range(3))
                prefix = [np.frombuffer(x, np.int64) for x in part.column(3).to_pylist()]
                ranges = np.array([np.bincount((np.frombuffer(x, np.uint64) >> np.uint64(44)).astype(np.int64) & (RANGES - 1), minlength=RANGES) for x in part.column(4).to_pylist()], np.int32)
                size = np.array([len(p) for p in prefix])
                at = np.repeat(np.arange(len(size)), size)
                rank = (np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
                columns = [np.concatenate(prefix), key[at], n[at], (n - shared)[at].astype(np.int32) + rank, rank, *(ranges[at, i] for i in range(RANGES))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "key", "n", "pos", "rank", *(f"s{i}" for i in range(RANGES))])

    return records.select("key", "n", "shared", "prefix", "grams").mapInArrow(run, schema)


def _possible(percent: int):
    """Length and suffix filter on two rows of postings, as a column condition."""
    na, nb = F.col("a.n").cast("long"), F.col("b.n").cast("long")
    bound = sum((F.least(F.col(f"a.s{i}"), F.col(f"b.s{i}")) for i in range(1, RANGES)), F.least(F.col("a.s0"), F.col("b.s0")))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * bound >= percent * (na + nb))


def _verified(pairs: DataFrame, records: DataFrame, percent: int) -> DataFrame:
    """(a, b) of those pairs that link: both sets are fetched and intersected once."""
    own = records.select("key", "n", "grams")
    full = pairs.join(own.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga")), "a").join(own.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy().astype(np.int64), batch.column(4).to_numpy().astype(np.int64)
            both = np.zeros(batch.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(batch.column(3), batch.column(5), strict=True)):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(u) > len(v):
                    u, v = v, u
                at = np.searchsorted(v, u)
                both[i] = np.count_nonzero(v[np.minimum(at, len(v) - 1)] == u)
            ok = pa.array(100 * both >= percent * (na + nb - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    return full.select("a", "b", "na", "ga", "nb", "gb").mapInArrow(run, "a long, b long")


def _block_links(probes: DataFrame, groups: DataFrame, records: DataFrame, percent: int, block: int = 256) -> DataFrame:
    """(a, b): for every probe (key, comp), a link into that component if there is one for each block of its sets.

    Probes and components are cut into blocks of about ``block`` sets; a row holds one
    block of each, so no pair of sets is ever a row.
    """
    own = records.select("key", F.struct("key", "n", "grams").alias("set"))
    asked = probes.select("comp").distinct()
    wide = groups.join(asked, "comp").join(groups.groupBy("comp").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "comp")
    there = wide.withColumn("part", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).join(own, "key").groupBy("comp", "part").agg(F.collect_list("set").alias("there"))
    blocks = wide.select("comp", "blocks").distinct()
    many = probes.groupBy("comp").agg(F.ceil(F.count("*") / block).cast("int").alias("probe_blocks"))
    here = probes.join(many, "comp").withColumn("probe", F.pmod(F.xxhash64("key"), F.col("probe_blocks")).cast("int")).join(own, "key").groupBy("comp", "probe").agg(F.collect_list("set").alias("here"))
    met = here.join(blocks, "comp").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(there, ["comp", "part"]).select("here", "there")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                here, there = batch.column(0)[row].values, batch.column(1)[row].values
                keys = there.field(0).to_numpy()
                sizes = there.field(1).to_numpy().astype(np.int64)
                sets = [np.frombuffer(x, np.uint64) for x in there.field(2).to_pylist()]
                grams, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
                order = np.argsort(grams, kind="stable")
                grams, owner = grams[order], owner[order]
                a, b = [], []
                for key, n, x in zip(here.field(0).to_pylist(), here.field(1).to_pylist(), here.field(2).to_pylist(), strict=True):
                    x = np.frombuffer(x, np.uint64)
                    lo, hi = np.searchsorted(grams, x), np.searchsorted(grams, x, side="right")
                    size = hi - lo
                    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
                    both = np.bincount(owner[at], minlength=len(sets))
                    linked = np.flatnonzero((100 * both >= percent * (n + sizes - both)) & (keys != key))
                    if len(linked):
                        other = int(keys[linked[0]])
                        a.append(min(key, other))
                        b.append(max(key, other))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def link_components(records: DataFrame, tables: Tables, percent: int = 75, rounds: int = 2, partners: int = 4) -> DataFrame:
    """(node, component) over the linked sets of ``records``, a table."""
    postings = tables.keep(_postings(records))
    links = comps = None
    grouped = postings.withColumn("comp", F.col("key"))
    for r in range(rounds):
        draw = F.xxhash64("key", "gram", F.lit(r))
        leader = grouped.groupBy("gram").agg(F.min_by(F.struct("key", "comp", "n", *(f"s{i}" for i in range(RANGES))), draw).alias("l"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("gram", "l.*")
        turn = (F.col("rank") >= (0 if r == 0 else partners * 4 ** (r - 1))) & (F.col("rank") < partners * 4**r)
        tries = grouped.where(turn).alias("a").join(leader.alias("b"), "gram").where("a.comp <> b.comp").where(_possible(percent))
        found = _verified(_ordered(tries.select(F.col("a.key").alias("x"), F.col("b.key").alias("y"))), records, percent)
        used = [t for t in (links, comps) if t is not None]
        links = tables.keep(found if links is None else links.unionByName(found).distinct())
        comps = components(links, tables)
        tables.drop(*used)
        grouped = postings.join(comps.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("component", "key")).drop("component")
    grouped = tables.keep(grouped)
    tables.drop(postings, comps)
    sizes = grouped.groupBy("gram", "comp").agg(F.count("*").alias("c"))
    home = sizes.groupBy("gram").agg(F.max_by("comp", F.struct("c", "comp")).alias("home"), F.count("*").alias("comps")).where("comps > 1").select("gram", "home")
    outside = tables.keep(grouped.join(home, "gram").where("comp <> home"))
    groups = tables.keep(grouped.select("key", "comp").distinct())
    tables.drop(grouped)
    inner = links.unionByName(_block_links(outside.select("key", F.col("home").alias("comp")).distinct(), groups, records, percent))
    met = outside.alias("a").join(outside.alias("b"), "gram").where("a.comp <> b.comp").where(F.col("a.key") < F.col("b.key")).where(_possible(percent))
    x, y = F.col("a.key"), F.col("b.key")
    first = x < y
    pick = lambda c: (F.when(first, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")), F.when(first, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")))
    (na, nb), (pa_, pb) = pick("n"), pick("pos")
    pairs = met.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), na.alias("na"), nb.alias("nb"), pa_.alias("pa"), pb.alias("pb")).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("met"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    rest = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1
    total = (F.col("na") + F.col("nb")).cast("long")
    pairs = pairs.where((100 + percent) * (F.col("met") + rest) >= percent * total).select("a", "b")
    last = _verified(pairs, records, percent)
    out = components(inner.unionByName(last), tables)
    tables.drop(links, outside, groups)
    return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75, slice_bytes: int = SLICE_BYTES // 2, tie: str | None = None) -> DataFrame:
    """One row per document row: id, n_shingles, component_id (smallest id reachable over links).

    With ``tie``, a long column that tells rows of one id apart, there are two more columns: ``tie``,
    and ``leads``, which is true on the rows of a component with its smallest id (null ids last)
    and of these the smallest tie, and null on rows with the empty set.
    """
    texts = docs.select(F.col(text).cast("string").alias("_text"))
    slices = buckets = text_slices(docs, text, slice_bytes)
    ties = [] if tie is None else ["_tie"]
    rows = docs.select(F.col(id_col), *[F.col(tie).alias(t) for t in ties], F.col(text).cast("string").alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "_text"):
            sets = Sets(batch.column(batch.num_columns - 1), n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sets.sizes, pa.int64()), pa.array(sets.keys.view(np.int64))], names=[id_col, *ties, "n_shingles", "key"])

    members = keep(rows.mapInArrow(sizes, f"`{id_col}` {kind}, {''.join(f'{t} long, ' for t in ties)}n_shingles long, key long"))
    packed = texts.mapInArrow(_senders(n, slices), _PACKED).repartition(slices, "part").sortWithinPartitions("part")
    shared = packed.mapInArrow(_counters(slices, buckets), _PACKED).repartition(buckets, "part").sortWithinPartitions("part")
    tables = Tables(docs.sparkSession)
    records = tables.keep(shared.mapInArrow(_recorders(percent), _RECORD))
    linked = link_components(records, tables, percent)
    tables.drop(records)
    least = members.where("n_shingles > 0").groupBy("key").agg(F.min(id_col).alias("least"), *[F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), t)).alias("lead") for t in ties]).join(linked.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("component", "key"))
    of_root = least.groupBy("root").agg(F.min("least").alias("component_id"), *[F.min("lead").alias("lead") for _ in ties])
    of_key = least.select("key", "root").join(of_root, "root").select("key", "component_id", *["lead" for _ in ties])
    leads = F.col(id_col).eqNullSafe(F.col("lead.id")) & (F.col("_tie") == F.col("lead._tie"))
    full = members.where("n_shingles > 0").join(of_key, "key").select(id_col, "n_shingles", "component_id", *[x for t in ties for x in (F.col(t).alias(tie), leads.alias("leads"))])
    rest = members.where("n_shingles = 0").select(id_col, "n_shingles", F.col(id_col).alias("component_id"), *[x for t in ties for x in (F.col(t).alias(tie), F.lit(None).cast("boolean").alias("leads"))])
    return full.unionByName(rest)
