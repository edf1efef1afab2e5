"""Nearest neighbours of every vector by an index of many tables over learned rotated binary codes.

Plan: (1) a rotation for codes is fitted on a bounded sample (iterative quantisation), cells are the nearest signed axes of two random
rotations a table; (2) one narrow pass turns each vector into its code and sends (cell, key, code) to PROBES cells of each of TABLES
tables, packed in binary blobs, one per partition and batch: the bytes a row are the same at every row count; (3) each cell finds all
pairs of codes within the Hamming radius by the pigeonhole rule over the code's four substrings and links them; links leave as stars,
never as all pairs; (4) links are contracted to candidate groups; (5) each vector moves once, to its group, where cosines are taken in
double precision. Groups beyond GROUP_ROWS are cut into chunks and compared chunk pair by chunk pair in different tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.graph import connected_components
from quern.session import durable, local_broadcast

#: Rows of the bounded sample on which rotations are fitted and the index is tried out.
SAMPLE_ROWS = 8_000
#: Tables of the index, cells a row goes to in each, and the rows that a cell should hold.
TABLES, PROBES, CELL_ROWS = 8, 4, 256
#: A cell beyond this many rows, by the sample's estimate, is compared piece by piece in different tasks.
PIECE_ROWS = 500_000
#: Bits of a code; its substrings are the 64-bit words.
BITS = 256
#: A candidate group up to this size is ranked inside one task.
GROUP_ROWS = 8_192
#: Rows of a chunk of a larger group.
CHUNK_ROWS = 16_384
MICRO = 1_000_000


def valid_block(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, keys and float64 vectors of the valid rows of a (key, vector, ...) batch.

    Valid: key present, dim numbers, all finite, not all zero.
    """
    vec = batch.column(1)
    fits = pc.and_(pc.equal(pc.fill_null(pc.list_value_length(vec), -1), dim), pc.is_valid(batch.column(0)))
    rows = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    if not len(rows):
        return rows, np.empty(0, np.int64), np.empty((0, dim))
    flat = vec.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
    v = flat.astype(np.float64).reshape(len(rows), dim)
    ok = np.isfinite(v).all(1) & (v != 0).any(1)
    rows, v = rows[ok], v[ok]
    keys = batch.column(0).take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(np.int64)
    return rows, keys, v


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def fit_rotation(x: np.ndarray, seed: int, rounds: int = 12) -> np.ndarray:
    """Iterative quantisation: alternates signs of the rotated sample with the orthogonal rotation that fits them best."""
    d = x.shape[1]
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    for _ in range(rounds if len(x) > d else 0):
        u, _, vt = np.linalg.svd(x.T @ np.sign(x @ r))
        r = u @ vt
    return r


@dataclass(frozen=True)
class Index:
    """Learned codes and the cells of TABLES tables; cells of a table: signed axes of one rotation times those of another."""

    mean: np.ndarray
    rotation: np.ndarray
    turns: tuple[np.ndarray, np.ndarray]
    parts: int
    near: int = BITS
    pieces: tuple[tuple[int, int], ...] = ()

    def codes(self, u: np.ndarray) -> np.ndarray:
        """(n, BITS / 64) words."""
        return np.packbits(((u - self.mean).astype(np.float32) @ self.rotation) > 0, axis=1).view(np.uint64)

    def cells(self, u: np.ndarray) -> np.ndarray:
        """(n, TABLES * PROBES) cell numbers, unlike between tables; -1 where there are fewer cells than probes."""
        x = (u - self.mean).astype(np.float32)
        out = np.full((len(u), TABLES, PROBES), -1, np.int64)
        for t in range(TABLES):
            (a, va), (b, vb) = (_axes(x @ side[t]) for side in self.turns)
            pairs = a.shape[1] * b.shape[1]
            total = (va[:, :, None] + vb[:, None, :]).reshape(len(u), pairs)
            number = (a[:, :, None] * (2 * self.turns[1].shape[2]) + b[:, None, :]).reshape(len(u), pairs)
            take = min(PROBES, total.shape[1])
            top = np.argpartition(-total, take - 1, axis=1)[:, :take] if total.shape[1] > take else np.tile(np.arange(take), (len(u), 1))
            out[:, t, :take] = np.take_along_axis(number, top, 1) + t * self.count
        return out.reshape(len(u), TABLES * PROBES)

    @property
    def count(self) -> int:
        """Cells of a table."""
        return 4 * self.turns[0].shape[2] * self.turns[1].shape[2]

    @property
    def nbytes(self) -> int:
        return self.mean.nbytes + self.rotation.nbytes + sum(x.nbytes for x in self.turns) + 64 * len(self.pieces)


def _axes(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The PROBES largest projections of each row: their signed axis numbers and sizes."""
    take = min(PROBES, s.shape[1])
    size = np.abs(s)
    at = np.argpartition(-size, take - 1, axis=1)[:, :take] if s.shape[1] > take else np.tile(np.arange(take), (len(s), 1))
    return 2 * at + (np.take_along_axis(s, at, 1) > 0), np.take_along_axis(size, at, 1)


def _trial(x: np.ndarray, similarity: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors at exactly this cosine; the second leans towards another row of the sample, so it lies where data lie."""
    x = x[rng.permutation(len(x))[:2_000]]
    other = x[rng.permutation(len(x))] if len(x) >= 256 else rng.standard_normal(x.shape)
    other = other - np.einsum("ij,ij->i", other, x)[:, None] * x
    size = np.linalg.norm(other, axis=1)
    ok = size > 1e-3
    x, other = x[ok], other[ok] / size[ok, None]
    return x, similarity * x + math.sqrt(max(0.0, 1 - similarity**2)) * other


def fit_index(vectors: DataFrame, dim: int, similarity: float, recall: float, seed: int = 7) -> Index:
    """The number of cells follows the row count, so that a cell holds some CELL_ROWS rows, as long as pairs at exactly `similarity`,
    tried out on the sample, share a cell of some table with probability `recall` (pairs above it do so more surely); beyond that
    cells grow instead. The Hamming radius holds all but 3 in 1,000 of those pairs."""
    n = max(1, vectors.count())
    pool = vectors.sample(min(1.0, 1.3 * SAMPLE_ROWS / n), seed).limit(SAMPLE_ROWS).toArrow()
    blocks = [valid_block(b, dim)[2] for b in pool.to_batches()]
    x = unit(np.concatenate(blocks)) if sum(map(len, blocks)) else np.zeros((0, dim))
    rng = np.random.default_rng(seed)
    mean = x.mean(0) if len(x) else np.zeros(dim)
    rotation = np.hstack([fit_rotation(x - mean, seed + i) for i in range(math.ceil(BITS / dim))])[:, :BITS].astype(np.float32)
    wide = [np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(TABLES)]).astype(np.float32) for _ in range(2)]
    one, two = _trial(x, similarity, rng)
    deep = min(2 * int(math.log2(dim)), max(0, round(math.log2(n * PROBES / CELL_ROWS)) - 2))
    while True:
        axes = [min(dim, 1 << (deep + 1) // 2), min(dim, 1 << deep // 2)]
        index = Index(mean, rotation, tuple(side[:, :, :m].copy() for side, m in zip(wide, axes)), max(12, math.ceil(n * TABLES * PROBES * RECORD.itemsize / 24e6)))
        a, b = (index.cells(v).reshape(len(v), TABLES, PROBES) for v in (one, two))
        met = ((a[:, :, :, None] == b[:, :, None, :]) & (a[:, :, :, None] >= 0)).any((2, 3)).any(1)
        if deep == 0 or not len(met) or met.mean() >= recall:
            break
        deep -= 1
    if not len(one):
        return index
    far = np.bitwise_count(index.codes(one) ^ index.codes(two)).sum(1)
    words, cells = index.codes(x), index.cells(x)
    _, alone = np.unique(np.ascontiguousarray(words).view(f"V{BITS // 8}").ravel(), return_index=True)  # copies are joined before they are sent
    cell, seen = np.unique(cells[alone].ravel(), return_counts=True)
    pieces = np.minimum(1_000, np.ceil(seen / len(x) * n / PIECE_ROWS)).astype(int)
    hot = (pieces > 1) & (seen > 8) & (cell >= 0)
    return replace(index, near=math.ceil(far.mean() + 2.75 * far.std()), pieces=tuple(zip(cell[hot].tolist(), pieces[hot].tolist())))


RECORD = np.dtype([("bucket", "<i8"), ("key", "<i8"), ("w", "<u8", (BITS // 64,))])


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers hashed to 31 bits by their product with an odd constant."""
    return (np.ascontiguousarray(x).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)


def _placed(ix: Index, keys: np.ndarray, words: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Records of the rows in their cells; a row of a hot cell goes to each pair of pieces that holds its own piece."""
    row, col = np.nonzero(cells >= 0)
    bucket = cells[row, col] << 20
    parts = [(row, bucket)]
    for cell, g in ix.pieces:
        at = np.flatnonzero(bucket == cell << 20)
        if len(at):
            own = mixed(keys[row[at]]) % g
            parts += [(row[at], bucket[at] | np.minimum(own, x) << 10 | np.maximum(own, x) + 1) for x in range(g)]
            bucket[at] = -1
    row, bucket = (np.concatenate(x) for x in zip(*parts))
    row, bucket = row[bucket >= 0], bucket[bucket >= 0]
    rec = np.empty(len(row), RECORD)
    rec["bucket"], rec["key"], rec["w"] = bucket, keys[row], words[row]
    return rec


def _emit(index, dim: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in it:
            _, keys, v = valid_block(batch, dim)
            if not len(keys):
                continue
            u = unit(v)
            words = ix.codes(u)
            # equal codes meet at once: one of them goes on, the others are linked to it (map-side combining of copies)
            _, first, same = np.unique(np.ascontiguousarray(words).view(f"V{BITS // 8}").ravel(), return_index=True, return_inverse=True)
            rep = first[same.ravel()]
            link = rep != np.arange(len(keys))
            keep = np.flatnonzero(~link)
            rec = _placed(ix, keys[keep], words[keep], ix.cells(u[keep]))
            part = mixed(rec["bucket"]) % ix.parts
            order = np.lexsort((rec["key"], part))  # a row's records in one partition stand together and compress
            rec, part = rec[order], part[order]
            cuts = np.flatnonzero(np.diff(part)) + 1
            out_part = part[np.concatenate([[0], cuts])].tolist() if len(part) else []
            out_blob = [c.tobytes() for c in np.split(rec, cuts)] if len(part) else []
            out_a, out_b = [None] * len(out_part), [None] * len(out_part)
            out_part += (keys[link] % ix.parts).tolist()
            out_blob += [None] * int(link.sum())
            out_a += keys[link].tolist()
            out_b += keys[rep[link]].tolist()
            yield pa.record_batch([pa.array(out_part, pa.int32()), pa.array(out_blob, pa.binary()), pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["part", "blob", "a", "b"])

    return run


def merge_labels(lab: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Unites the sets of x[i] and y[i]; lab holds each element's smallest member."""
    while len(x):
        lx, ly = lab[x], lab[y]
        d = lx != ly
        if not d.any():
            break
        x, y, lx, ly = x[d], y[d], lx[d], ly[d]
        np.minimum.at(lab, np.maximum(lx, ly), np.minimum(lx, ly))
        while True:
            up = lab[lab]
            if (up == lab).all():
                break
            lab = up
    return lab


def bucket_labels(words: np.ndarray, near: int, tile: int = 256) -> np.ndarray:
    """Groups of the codes of one cell that are joined by steps within the Hamming radius.

    Pigeonhole rule: of m substrings one differs in at most near // m bits where the whole code differs in at most near, so every code
    within the radius is met; its whole distance is then taken. Tile pairs that lie in one group already are skipped, so a bucket of near copies costs one pass, not its square.
    """
    g = len(words)
    lab = np.arange(g)
    order = None
    for j in range(0, g, tile):
        if j == tile and g > 4 * tile:  # after the pass against the first tile, members of a group stand together
            order = np.argsort(lab, kind="stable")
            words = words[order]
            back = np.empty(g, np.int64)
            firsts = {}
            for pos, old in enumerate(lab[order].tolist()):
                back[pos] = firsts.setdefault(old, pos)
            lab = back
            starts = range(0, g, tile)
        else:
            starts = range(j, g, tile)
        for i in starts:
            if i < j:
                continue
            a, b = lab[j : j + tile], lab[i : i + tile]
            if a[0] == b[0] and (a == a[0]).all() and (b == b[0]).all():
                continue
            wa, wb = words[j : j + tile], words[i : i + tile]
            share = near // words.shape[1]
            met = np.bitwise_count(wa[:, None, 0] ^ wb[None, :, 0]) <= share
            for w in range(1, words.shape[1]):
                met |= np.bitwise_count(wa[:, None, w] ^ wb[None, :, w]) <= share
            x, y = np.divmod(np.flatnonzero(met.ravel()), len(wb))
            x, y = x + j, y + i
            new = (x < y) & (lab[x] != lab[y])
            x, y = x[new], y[new]
            if len(x):
                ok = np.bitwise_count(words[x] ^ words[y]).sum(1) <= near
                lab = merge_labels(lab, x[ok], y[ok])
    if order is not None:
        out = np.empty(g, np.int64)
        out[order] = order[lab]
        lab = out
    return lab


def _link(index):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        blobs, a_out, b_out = [], [], []
        for batch in it:
            blob, a, b = batch.column(1), batch.column(2), batch.column(3)
            blobs += [np.frombuffer(x.as_buffer(), RECORD) for x in blob if x.is_valid]
            has = pc.is_valid(a)
            a_out.append(a.filter(has).to_numpy(zero_copy_only=False)), b_out.append(b.filter(has).to_numpy(zero_copy_only=False))
        if blobs:
            rec = np.concatenate(blobs)
            del blobs
            rec = rec[np.argsort(rec["bucket"], kind="stable")]
            edge = np.flatnonzero(np.diff(rec["bucket"])) + 1
            for lo, hi in zip(np.concatenate([[0], edge]), np.concatenate([edge, [len(rec)]])):
                if hi - lo < 2:
                    continue
                keys = rec["key"][lo:hi]
                lab = bucket_labels(rec["w"][lo:hi], ix.near)
                moved = np.flatnonzero(lab != np.arange(hi - lo))
                if len(moved):  # a star around the group's smallest key
                    members = np.unique(np.concatenate([moved, lab[moved]]))
                    root = np.full(hi - lo, np.iinfo(np.int64).max)
                    np.minimum.at(root, lab[members], keys[members])
                    a_out.append(keys[members]), b_out.append(root[lab[members]])
        a, b = np.concatenate([*a_out, []]).astype(np.int64), np.concatenate([*b_out, []]).astype(np.int64)
        both = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1)[a != b], axis=0)
        yield pa.record_batch([pa.array(both[:, 0], pa.int64()), pa.array(both[:, 1], pa.int64())], names=["a", "b"])

    return run


def hamming_links(vectors: DataFrame, dim: int, similarity: float, recall: float) -> DataFrame:
    """Stars (a, b) over the rows of (key, vector) whose codes lie within the radius that `similarity` implies."""
    spark = vectors.sparkSession
    fitted = fit_index(vectors, dim, similarity, recall)
    index = local_broadcast(spark, fitted, 64 << 20, fitted.nbytes)
    sent = vectors.mapInArrow(_emit(index, dim), "part int, blob binary, a bigint, b bigint").repartition(fitted.parts, "part")
    return sent.mapInArrow(_link(index), "a bigint, b bigint").distinct()


def runs(it: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables that hold whole groups, from a partition sorted by `column`; a group is never cut."""
    held: list[pa.RecordBatch] = []
    for batch in it:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        last = col[batch.num_rows - 1]
        start = pc.index(col, last).as_py()
        if held and start == 0 and held[-1].column(column)[0] == last and held[-1].num_rows and held[-1].column(column)[held[-1].num_rows - 1] == last:
            held.append(batch)
            continue
        if start or held:
            done = [*held, batch.slice(0, start)]
            if held and start == 0:
                done = held
            yield pa.Table.from_batches([b for b in done if b.num_rows])
        held = [batch.slice(start)]
    if held:
        yield pa.Table.from_batches(held)


def spans(values: np.ndarray) -> Iterator[tuple[int, int]]:
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    yield from zip([0, *cut.tolist()], [*cut.tolist(), len(values)])


def best(qa: np.ndarray, ka: np.ndarray, kb: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of each row's k largest micro-similarities; ties go to the smaller key, a row's own key is left out."""
    order = np.argsort(kb, kind="stable")
    rank = np.empty(len(kb), np.int64)
    rank[order] = np.arange(len(kb))
    score = qa * (len(kb) + 1) - rank[None, :]
    score[ka[:, None] == kb[None, :]] = np.iinfo(np.int64).min
    kk = min(k, score.shape[1])
    cols = np.argpartition(score, score.shape[1] - kk, axis=1)[:, score.shape[1] - kk :]
    rows = np.repeat(np.arange(len(ka)), kk)
    cols = cols.ravel()
    ok = score[rows, cols] > np.iinfo(np.int64).min
    return rows[ok], cols[ok]


def micro(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(a @ b.T, -1, 1) * MICRO).astype(np.int64)


def grouped_vectors(vectors: DataFrame, dim: int, similarity: float, recall: float) -> tuple[DataFrame, DataFrame, bool]:
    """((comp, key, vector) of groups up to GROUP_ROWS, (comp, rows, key, vector) of larger ones, whether there are larger ones)."""
    links = durable(hamming_links(vectors, dim, similarity, recall))  # read twice by the first contraction
    comp = durable(connected_components(links))
    large = durable(comp.groupBy("comp").count().where(F.col("count") > GROUP_ROWS))
    hot = not large.isEmpty()
    placed = vectors.toDF("node", "vector").join(comp, "node").select("comp", F.col("node").alias("key"), "vector")
    if not hot:
        return placed, None, False
    return placed.join(large.select("comp"), "comp", "left_anti"), placed.join(large.withColumnRenamed("count", "n"), "comp").select("comp", "n", "key", "vector"), True


def _rank_groups(dim: int, k: int, floor: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(it, "comp"):
            for b in t.combine_chunks().select(["key", "vector", "comp"]).to_batches():
                rows, keys, v = valid_block(b, dim)
                comp = b.column(2).to_numpy(zero_copy_only=False)[rows]
                u = unit(v)
                oa, ob, oq = [], [], []
                for lo, hi in spans(comp) if len(comp) else []:
                    for s in range(lo, hi, 1024):
                        e = min(hi, s + 1024)
                        q = micro(u[s:e], u[lo:hi])
                        r, c = best(q, keys[s:e], keys[lo:hi], k)
                        hit = q[r, c]
                        r, c, hit = r[hit >= floor], c[hit >= floor], hit[hit >= floor]
                        oa.append(keys[s:e][r]), ob.append(keys[lo:hi][c]), oq.append(hit)
                if oa:
                    yield pa.record_batch([pa.array(np.concatenate(oa), pa.int64()), pa.array(np.concatenate(ob), pa.int64()), pa.array(np.concatenate(oq), pa.int64())], names=["key", "neighbour", "micro"])

    return run


def chunk_pairs(large: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """(comp, i, j, c, key, vector): every row of a large group in each chunk pair that holds its chunk c, i <= j."""
    chunks = F.ceil(F.col("n") / rows).cast("int")
    own = large.withColumn("m", chunks).withColumn("c", F.pmod(F.xxhash64("key"), F.col("m")).cast("int"))
    return own.select("comp", "c", "key", "vector", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("x")).select("comp", F.least("c", "x").alias("i"), F.greatest("c", "x").alias("j"), "c", "key", "vector")


def _rank_chunks(dim: int, k: int, floor: int, normal: bool = True):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(it, "group"):
            t = t.combine_chunks()
            for b in t.select(["key", "vector", "group", "i", "j", "c"]).to_batches():
                rows, keys, v = valid_block(b, dim)
                group, i, j, c = (b.column(x).to_numpy(zero_copy_only=False)[rows] for x in (2, 3, 4, 5))
                u = unit(v) if normal else v
                for lo, hi in spans(group) if len(group) else []:
                    sides = [(c[lo:hi] == i[lo:hi], c[lo:hi] == j[lo:hi])]
                    if i[lo] != j[lo]:
                        sides.append(sides[0][::-1])
                    for left, right in sides:
                        ka, ua, kb, ub = keys[lo:hi][left], u[lo:hi][left], keys[lo:hi][right], u[lo:hi][right]
                        if not len(ka) or not len(kb):
                            continue
                        for s in range(0, len(ka), 512):
                            q = micro(ua[s : s + 512], ub)
                            r, cc = best(q, ka[s : s + 512], kb, k)
                            hit = q[r, cc]
                            ok = hit >= floor
                            yield pa.record_batch([pa.array(ka[s : s + 512][r[ok]], pa.int64()), pa.array(kb[cc[ok]], pa.int64()), pa.array(hit[ok], pa.int64())], names=["key", "neighbour", "micro"])

    return run


def similar_neighbours(vectors: DataFrame, k: int = 5, similarity: float = 0.75, dim: int = 128, recall: float = 0.95) -> DataFrame:
    """(key, neighbour, micro): of every valid row of (key, vector), its k most similar others with cosine >= similarity.

    micro is the cosine times 10^6, rounded; of equals the smaller neighbour key comes first. Rows with a null key or an invalid
    vector (null, another length, a null or non-finite number, all zero) have no result and are nobody's neighbour; repeated vectors
    are neighbours of each other with cosine 1; a key that occurs twice is never its own neighbour. Extra columns are ignored:
    pass key and vector in this order. An empty table gives an empty result. `recall` is what the index promises for a pair at
    exactly `similarity`; inside a candidate group ranking is exact.
    """
    vectors = vectors.select(*vectors.columns[:2])
    small, large, hot = grouped_vectors(vectors, dim, similarity, recall)
    floor = round(similarity * MICRO)
    schema = "key bigint, neighbour bigint, micro bigint"
    out = small.repartition("comp").sortWithinPartitions("comp", "key").mapInArrow(_rank_groups(dim, k, floor), schema)
    if hot:
        front, rest = copies_apart(large, k)
        pairs = chunk_pairs(front).withColumn("group", F.xxhash64("comp", "i", "j"))
        ranked = pairs.repartition("group").sortWithinPartitions("group").mapInArrow(_rank_chunks(dim, k, floor), schema)
        w = Window.partitionBy("key").orderBy(F.desc("micro"), "neighbour")
        ranked = durable(ranked.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn"))
        out = out.unionByName(ranked)
        if not rest.isEmpty():  # a further copy has the neighbours of its first copy and that copy itself
            firsts = rest.select("first").distinct()
            near = ranked.join(firsts, ranked["key"] == firsts["first"]).select("first", "neighbour", "micro").union(firsts.select("first", "first", F.lit(MICRO).cast("bigint")))
            w = Window.partitionBy("first").orderBy(F.desc("micro"), "neighbour")
            near = near.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
            out = out.unionByName(rest.join(near, "first").select("key", "neighbour", "micro"))
    return out


def copies_apart(large: DataFrame, k: int, salts: int = 64) -> tuple[DataFrame, DataFrame]:
    """(the k + 1 first keys of each vector of (comp, n, key, vector), n counted anew; (key, first) of all further copies).

    The first keys are found within salts and then over them, so that no task sorts all copies of a vector."""
    w = Window.partitionBy("comp", "vector", "salt").orderBy("key")
    salted = large.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts))).withColumn("rn", F.row_number().over(w))
    w = Window.partitionBy("comp", "vector").orderBy("key")
    lead = durable(salted.where(F.col("rn") <= k + 1).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k + 1).select("comp", "vector", "key", "place"))
    front = lead.join(lead.groupBy("comp").agg(F.count("*").alias("n")), "comp").select("comp", "n", "key", "vector")
    full = lead.where(F.col("place") == k + 1).select("comp", "vector", F.col("key").alias("last"))
    heads = lead.where("place = 1").select("comp", "vector", F.col("key").alias("first")).join(full, ["comp", "vector"])
    rest = large.join(heads, ["comp", "vector"]).where(F.col("key") > F.col("last")).select("key", "first")
    return front, durable(rest)


def _block_scan(queries, dim: int, k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qk, qu = queries.value
        top_s = np.full((len(qk), k), -MICRO - 1)
        top_k = np.full((len(qk), k), np.iinfo(np.int64).max)
        for batch in it:
            _, keys, v = valid_block(batch, dim)
            if not len(keys):
                continue
            u = unit(v)
            order = np.argsort(keys)
            keys, u = keys[order], u[order]
            for s in range(0, len(qk), 512):
                q = micro(qu[s : s + 512], u)
                r, c = best(q, qk[s : s + 512], keys, k)
                cs = np.full((len(q), k), -MICRO - 1)
                ck = np.full((len(q), k), np.iinfo(np.int64).max)
                slot = np.concatenate([np.arange(n) for n in np.bincount(r, minlength=len(q))]) if len(r) else np.empty(0, int)
                cs[r, slot], ck[r, slot] = q[r, c], keys[c]
                alls, allk = np.hstack([top_s[s : s + 512], cs]), np.hstack([top_k[s : s + 512], ck])
                pick = np.lexsort((allk, -alls), axis=1)[:, :k]
                top_s[s : s + 512], top_k[s : s + 512] = np.take_along_axis(alls, pick, 1), np.take_along_axis(allk, pick, 1)
        r, c = np.nonzero(top_k < np.iinfo(np.int64).max)
        yield pa.record_batch([pa.array(qk[r], pa.int64()), pa.array(top_k[r, c], pa.int64()), pa.array(top_s[r, c], pa.int64())], names=["key", "neighbour", "micro"])

    return run


def nearest_of(queries: DataFrame, vectors: DataFrame, k: int = 5, dim: int = 128, block: int = 4_096) -> DataFrame:
    """(key, neighbour, micro) of the k most similar vectors for a stated query set: the exact way for what lies beyond the index's
    radius. Queries go out in blocks of `block` rows (the broadcast's bound: block x dim doubles), each block against one scan of
    all vectors, which keeps k rows for each query and partition."""
    spark = vectors.sparkSession
    vectors = vectors.select(*vectors.columns[:2])
    keyed = queries.select(*queries.columns[:2]).toDF("qk", "qv").where("qk is not null")
    n = keyed.count()
    out = None
    for i in range(max(1, math.ceil(n / block))):
        part = keyed if n <= block else keyed.where(F.pmod(F.xxhash64("qk"), F.lit(math.ceil(n / block))) == i)
        blocks = [valid_block(b, dim)[1:] for b in part.toArrow().to_batches()]
        keys = np.concatenate([b[0] for b in blocks] or [np.empty(0, np.int64)])
        u = unit(np.concatenate([b[1] for b in blocks])) if len(keys) else np.empty((0, dim))
        sent = local_broadcast(spark, (keys, u), 3 * block * (dim + 1) * 8, keys.nbytes + u.nbytes)
        scanned = vectors.mapInArrow(_block_scan(sent, dim, k), "key bigint, neighbour bigint, micro bigint")
        out = scanned if out is None else out.unionByName(scanned)
    w = Window.partitionBy("key").orderBy(F.desc("micro"), "neighbour")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
