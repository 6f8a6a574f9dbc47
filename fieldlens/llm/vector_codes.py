"""Vector code compression: product codebooks by filtering Lloyd.

Vectors become integers, floor(scale * x), and are cut into parts. Spark deals the
rows to blocks of at most ``BLOCK`` rows; each block builds a kd-tree over each of
its parts with numpy and stores it, once: bounding boxes, sums and counts of all
nodes, and the points in leaf order. A round is one job over those trees with the
codebooks as they are, a few kilobytes. Nodes are filtered level by level: of a
node's candidate entries the one nearest to the middle of its box rules out all that
are no nearer anywhere in the box; a node with one candidate left gives its cached
sum and count to that entry as a whole; only leaves that keep several candidates
look at their points. Blocks return a row for each part and entry, which Spark adds
up. All numbers are integers, so results are exact and don't depend on the blocks.

Defined results: vectors that are null, empty, or hold null or non-finite components
take no part, nor do those of another length than the vector with the smallest id;
null ids come after all others; of rows that repeat an id those with the smaller
vector come first; fewer rows than entries make a codebook of as many entries as
there are rows; a length that the parts don't divide gives the first parts one
component more; extra columns are not read; an empty table gives an empty result.
Numbers whose sums of squares may not fit 64 bits are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, materialize
from .vector_topk import usable

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows of a block, and points of a leaf at most.
BLOCK, LEAF = 4096, 16
#: Labels whose sums are broadcast at most; more are joined.
MOST_LABELS = 100_000


def edges(n: int, leaf: int = LEAF) -> list[np.ndarray]:
    """For each level of a tree over ``n`` points, where its nodes begin and end: halves
    of halves until no node has more than ``leaf`` points."""
    levels = [np.array([0, n])]
    while np.diff(levels[-1]).max() > leaf:
        e = levels[-1]
        levels.append(np.sort(np.concatenate([e, (e[:-1] + e[1:]) // 2])))
    return levels


def build(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(order, [(low, high, total) of each level]): nodes are split at the median of
    their widest side."""
    order, levels = np.arange(len(points)), []
    cuts = edges(len(points), leaf)
    for depth, e in enumerate(cuts):
        x = points[order]
        low, high = np.minimum.reduceat(x, e[:-1]), np.maximum.reduceat(x, e[:-1])
        levels.append((low, high, np.add.reduceat(x, e[:-1])))
        if depth + 1 < len(cuts):
            node = np.repeat(np.arange(len(e) - 1), np.diff(e))
            along = x[np.arange(len(x)), (high - low).argmax(axis=1)[node]] if x.shape[1] else node
            order = order[np.lexsort((along, node))]
    return order, levels


def filtered(levels: list[tuple], points: np.ndarray, codebook: np.ndarray, leaf: int = LEAF, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) of the entries over the points, which stand in leaf order; also
    each point's entry in ``codes``. A tie goes to the lower entry."""
    k, d = codebook.shape
    sums, counts = np.zeros((k, d), dtype=np.int64), np.zeros(k, dtype=np.int64)
    cuts, square = edges(len(points), leaf), (codebook**2).sum(axis=1)
    node, able = np.array([0]), np.ones((1, k), dtype=bool)
    for depth, (low, high, total) in enumerate(levels):
        lo, hi, e = low[node], high[node], cuts[depth]
        # Twice the distance's part that depends on the entry, at twice the middle.
        far = 2 * square - 2 * (lo + hi) @ codebook.T
        best = np.where(able, far, np.iinfo(np.int64).max).argmin(axis=1)
        aim = codebook[None, :, :] - codebook[best][:, None, :]
        corner = np.where(aim > 0, hi[:, None, :], lo[:, None, :])
        # How much farther an entry is than the best one, at the point that favours it most.
        gain = square[None, :] - square[best][:, None] - 2 * (corner * aim).sum(axis=2)
        entry = np.arange(k)[None, :]
        able &= (gain < 0) | ((gain == 0) & (entry < best[:, None])) | (entry == best[:, None])
        alone = able.sum(axis=1) == 1
        done, to = node[alone], able[alone].argmax(axis=1)
        np.add.at(sums, to, total[done])
        np.add.at(counts, to, np.diff(e)[done])
        if codes is not None:
            for i, j, c in zip(e[done], e[done + 1], to, strict=True):
                codes[i:j] = c
        node, able = node[~alone], able[~alone]
        if not len(node):
            break
        if depth + 1 < len(levels):
            node, able = np.concatenate([2 * node, 2 * node + 1]), np.concatenate([able, able])
            continue
        size = np.diff(e)[node]
        which = np.repeat(np.arange(len(node)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(e[node], size)
        own = points[at]
        to = np.where(able[which], square - 2 * own @ codebook.T, np.iinfo(np.int64).max).argmin(axis=1)
        np.add.at(sums, to, own)
        counts += np.bincount(to, minlength=k)
        if codes is not None:
            codes[at] = to
    return sums, counts


def _spans(width: int, parts: int) -> list[tuple[int, int]]:
    """First and last component of each part."""
    ends = np.cumsum([len(x) for x in np.array_split(np.arange(width), parts)]).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def _narrow(x: np.ndarray) -> bytes:
    """As 32-bit integers if they fit; the reader knows by the length."""
    fits = not x.size or (x.min() >= -(2**31) and x.max() < 2**31)
    return np.ascontiguousarray(x, dtype="<i4" if fits else "<i8").tobytes()


def _wide(raw: bytes, rows: int, d: int) -> np.ndarray:
    kind = "<i8" if rows * d and len(raw) == 8 * rows * d else "<i4"
    return np.frombuffer(raw, dtype=kind).astype(np.int64).reshape(rows, d)


def _trees(rows: DataFrame, spans: list[tuple[int, int]], block: int) -> DataFrame:
    """One row for each block: its ids, labels and trees."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("_id", "_label")}
    tree = pa.struct([("dim", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("low", "high", "total", "points", "places"))])

    def planted(x: np.ndarray, a: int, b: int) -> dict:
        order, levels = build(x[:, a:b])
        low, high, total = (np.concatenate([lev[i] for lev in levels]) for i in range(3))
        return {"dim": b - a, "n": len(x), "low": _narrow(low), "high": _narrow(high), "total": _narrow(total), "points": _narrow(x[order, a:b]), "places": order.astype("<i4").tobytes()}

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, block):
                b = batch.slice(i, block)
                x = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, -1)
                trees = pa.array([[planted(x, *s) for s in spans]], pa.list_(tree))
                one = lambda c: pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(c))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([one(0), one(1), trees], names=["ids", "labels", "trees"])

    fields = "dim:int,n:int,low:binary,high:binary,total:binary,points:binary,places:binary"
    return rows.select("_id", "_label", "_v").mapInArrow(run, f"ids array<{kinds['_id']}>, labels array<{kinds['_label']}>, trees array<struct<{fields}>>")


def _opened(tree: dict) -> tuple[list[tuple], np.ndarray]:
    n, d = tree["n"], tree["dim"]
    sizes = [len(e) - 1 for e in edges(n)]
    stops = np.cumsum(sizes)
    low, high, total = (_wide(tree[c], int(stops[-1]), d) for c in ("low", "high", "total"))
    return [(low[j - s : j], high[j - s : j], total[j - s : j]) for s, j in zip(sizes, stops, strict=True)], _wide(tree["points"], n, d)


def _round(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one more round. Of each block a row for each part and
    entry comes out; the driver sees parts x entries rows."""

    def run(batches):
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("part", "entry", "n", "sums")}
            for trees_ in b.column(0).to_pylist():
                for part, tree in enumerate(trees_):
                    levels, points = _opened(tree)
                    sums, counts = filtered(levels, points, books[part])
                    out["part"] += [part] * len(counts)
                    out["entry"] += range(len(counts))
                    out["n"] += counts.tolist()
                    out["sums"] += sums.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out["part"], pa.int32()), pa.array(out["entry"], pa.int32()), pa.array(out["n"], pa.int64()), pa.array(out["sums"], pa.list_(pa.int64()))], names=list(out))

    partial = trees.select("trees").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    widest = max(x.shape[1] for x in books)
    exact = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(widest)]
    new = [x.copy() for x in books]
    for r in partial.where("n > 0").groupBy("part", "entry").agg(F.sum("n").alias("n"), *exact).collect():
        for i in range(books[r.part].shape[1]):
            new[r.part][r.entry, i] = int(r[f"s{i}"]) // r.n
    return new


def _coded(trees: DataFrame, books: list[np.ndarray], kinds: dict[str, str]) -> DataFrame:
    """(_id, _label, code, error) of every vector."""

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                codes, error = [], 0
                for part, tree in enumerate(b.column(2)[row].as_py()):
                    levels, points = _opened(tree)
                    own = np.empty(len(points), dtype=np.int64)
                    filtered(levels, points, books[part], codes=own)
                    places = np.frombuffer(tree["places"], dtype="<i4")
                    off, back = ((points - books[part][own]) ** 2).sum(axis=1), np.argsort(places)
                    error = error + off[back]
                    codes.append(own[back].astype(np.uint8))
                text = np.stack(codes, axis=1).tobytes().hex()
                each = [text[i : i + 2 * len(codes)] for i in range(0, len(text), 2 * len(codes))]
                yield pa.RecordBatch.from_arrays([b.column(0)[row].values, b.column(1)[row].values, pa.array(each), pa.array(error)], names=["_id", "_label", "code", "error"])

    return trees.select("ids", "labels", "trees").mapInArrow(run, f"_id {kinds['_id']}, _label {kinds['_label']}, code string, error long")


def fit_codebooks(trees: DataFrame, seeds: np.ndarray, spans: list[tuple[int, int]], rounds: int) -> Iterator[list[np.ndarray]]:
    """The codebooks at the start and after each round."""
    books = [seeds[:, a:b] for a, b in spans]
    yield books
    for _ in range(rounds):
        books = _round(trees, books)
        yield books


def codebook_text(books: list[np.ndarray]) -> str:
    return ",".join(str(v) for book in books for entry in book.tolist() for v in entry)


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """Per usable vector: the id, code (a byte a part in hex), error (squared distances
    to the entries), label_error (its sum over equal labels), codebooks_sha256."""
    spark = vectors.sparkSession
    bound_batches(spark)
    label = F.col(label_col) if label_col else F.lit(None).cast("string")
    scaled = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.where(usable(F.col(vector_col))).select(F.col(id_col).alias("_id"), label.alias("_label"), scaled.alias("_v"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("_id", "_label")}
    first = rows.select("_id", "_v").orderBy(F.col("_id").asc_nulls_last(), "_v").limit(1).collect()
    shape = f"`{id_col}` {kinds['_id']}, code string, error long, label_error long, codebooks_sha256 string"
    if not first:
        return spark.createDataFrame([], shape)
    width = len(first[0]._v)
    rows = rows.where(F.size("_v") == width)
    seeds = rows.select("_id", "_v").orderBy(F.col("_id").asc_nulls_last(), "_v").limit(entries).collect()
    high, low = rows.agg(F.max(F.array_max("_v")), F.min(F.array_min("_v"))).first()
    spans = _spans(width, parts)
    if max(1, width) * (4 * max(abs(high), abs(low), 1)) ** 2 >= 2**62:
        raise ValueError(f"squared distances of {width} components up to {max(abs(high), abs(low))} may not fit 64 bits")
    trees, _ = materialize(_trees(rows, spans, block), "trees")
    *_, books = fit_codebooks(trees, np.array([r._v for r in seeds], dtype=np.int64), spans, rounds)
    coded, _ = materialize(_coded(trees, books, kinds), "codes")
    digest = hashlib.sha256(codebook_text(books).encode()).hexdigest()
    sums = coded.groupBy(F.col("_label").alias("_of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("_sum"))
    few = sums.limit(MOST_LABELS + 1).count() <= MOST_LABELS
    joined = coded.join(F.broadcast(sums) if few else sums, F.col("_label").eqNullSafe(F.col("_of")))
    return joined.select(F.col("_id").alias(id_col), "code", "error", F.col("_sum").alias("label_error"), F.lit(digest).alias("codebooks_sha256"))
