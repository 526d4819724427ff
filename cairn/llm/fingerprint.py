"""Document fingerprints: a Merkle tree over paragraphs and sections.

A text's lines are its paragraphs, runs of lines with a word, and of lines without, its sections. Each paragraph has leaves:
runs of its words whose ends are chosen by the words themselves, so that an edit moves no boundary but its own. A leaf of
level k + 1 is the digest of its leaves of level k (words at level 0), and ends at a word whose digest ends in k + 1 zeros or
with its paragraph. A text has the lowest level at which its leaves are no more than most_leaves besides one a paragraph, so a
fingerprint grows with paragraphs, not with words. A paragraph's node is the digest of its line, a section's that of its
paragraphs' nodes, the root's that of the sections' nodes: roots are equal where texts are.

The fingerprint is the root and the tree: nodes of paragraphs, from which follow those of sections, and leaves. Two trees are
walked from the root down: sections in common are set aside, then paragraphs in common of the sections left, then leaves in
common of the paragraphs left; a tree of lower level is first raised to the other's. Likeness is what was set aside over the
mean size, in paragraphs and leaves; 1 where roots are equal. locate() finds the paragraphs where two trees differ. Both need
fingerprints alone, not texts.

Null and empty texts: the fingerprint of an empty text, likeness 1 to another empty text. A text of one word has one leaf, so
nothing of it is in common with an edited one. Very long texts are read whole. Rows with the same doc_id are ordered by a hash
of their texts, then by their texts; null ids come first. Repeated rows follow one another. The only document is its own next
one. An empty table gives an empty result. Extra columns are not read. doc_id must be of an integer type. No table is
collected; the bounds of ranges are.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import common
from .common import WordHashes, mixed, shipped, texts_of

shipped(__name__)


def digest(x: bytes) -> bytes:
    return hashlib.sha256(x).digest()


GOLD, TOP_LEVEL = np.uint64(0x9E3779B97F4A7C15), 20
DIGEST, RANK = np.uint64(38), np.uint32(31)  # 26 bits of a leaf's digest and 5 of its rank, one marks a paragraph's first


class Tree:
    """root (hex), level; nodes of paragraphs (30 bits, first of a section, has leaves), leaves (digest, rank, paragraph)."""

    def __init__(self, root: str, level: int, nodes: np.ndarray, first: np.ndarray, digest: np.ndarray, rank: np.ndarray, of: np.ndarray):
        self.root, self.level, self.nodes, self.first, self.digest, self.rank, self.of = root, level, nodes, first, digest, rank, of
        self._sections = None

    def raised(self, level: int) -> Tree:
        """The same tree with leaves of a higher level."""
        digest, rank, of = self.digest, self.rank, self.of
        for k in range(self.level + 1, level + 1):
            digest, rank, of = merged(digest, rank, of, k)
        out = Tree(self.root, max(level, self.level), self.nodes, self.first, digest, rank, of)
        out._sections = self._sections
        return out

    def sections(self) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of the sections, and where they begin, in paragraphs, with the end behind."""
        if self._sections is None:
            starts = self.first.nonzero()[0]
            bounds = np.concatenate([starts, [len(self.nodes)]])
            order = np.arange(len(self.nodes)) - np.repeat(starts, bounds[1:] - starts)
            self._sections = mixed(np.add.reduceat(mixed(self.nodes.astype(np.uint64) + order.astype(np.uint64) * GOLD), starts)), bounds
        return self._sections


def merged(digest: np.ndarray, rank: np.ndarray, of: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaves of one level from those of the level below: runs that end at a rank of level or more, or with the paragraph."""
    if not len(digest):
        return digest, rank, of
    last = rank >= level
    last[:-1] |= of[1:] != of[:-1]
    last[-1] = True
    ends = last.nonzero()[0]
    starts = np.empty_like(ends)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    order = np.arange(len(digest)) - np.repeat(starts, ends - starts + 1)
    total = np.add.reduceat(mixed(digest + order.astype(np.uint64) * GOLD + np.uint64(level)), starts)
    return mixed(total) >> DIGEST, rank[ends], of[ends]


class Fingerprints:
    """most_leaves: of a text, besides one for each of its paragraphs."""

    def __init__(self, most_leaves: int = 32):
        self.words, self.most = WordHashes(), most_leaves

    def tree(self, text: bytes) -> Tree:
        lines = text.split(b"\n")
        split = [line.split() for line in lines]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        full = [digest(line) for line in lines]
        first = np.append(True, (counts[1:] > 0) != (counts[:-1] > 0))
        starts = np.flatnonzero(first).tolist()
        root = digest(b"".join([digest(b"".join(full[a:b])) for a, b in zip(starts, [*starts[1:], len(full)])])).hex()
        nodes = np.frombuffer(b"".join([d[:4] for d in full]), "<u4") & np.uint32(0x3FFFFFFF)
        h = mixed(self.words.of([w for ws in split for w in ws]))
        low = (h & (~h + np.uint64(1))).astype(np.float64)
        rank = np.minimum(np.where(low > 0, np.log2(np.maximum(low, 1)), TOP_LEVEL), TOP_LEVEL).astype(np.uint32)
        leaves, level = (h >> DIGEST, rank, np.repeat(np.arange(len(lines)), counts)), 0
        most = self.most + int((counts > 0).sum())
        while len(leaves[0]) > most and level < TOP_LEVEL:
            level += 1
            leaves = merged(*leaves, level)
        return Tree(root, level, nodes, first, *leaves)


def written(t: Tree) -> str:
    has = np.zeros(len(t.nodes), np.uint32)
    has[t.of] = 1
    head = np.append(True, t.of[1:] != t.of[:-1])[: len(t.of)].astype(np.uint32)
    nodes = t.nodes | t.first.astype(np.uint32) << np.uint32(30) | has << np.uint32(31)
    leaves = t.digest.astype(np.uint32) << np.uint32(6) | t.rank << np.uint32(1) | head
    packed = bytes([t.level]) + np.uint32(len(nodes)).astype("<u4").tobytes() + nodes.astype("<u4").tobytes() + leaves.astype("<u4").tobytes()
    return f"{t.root}:{base64.b64encode(packed).decode()}"


def parsed(fingerprint: str) -> Tree:
    root, _, tail = fingerprint.partition(":")
    raw = base64.b64decode(tail)
    n = int.from_bytes(raw[1:5], "little")
    nodes, leaves = np.frombuffer(raw, "<u4", n, 5), np.frombuffer(raw, "<u4", -1, 5 + 4 * n) if len(raw) > 5 + 4 * n else np.empty(0, np.uint32)
    of = np.flatnonzero(nodes >> np.uint32(31))[np.cumsum(leaves & np.uint32(1)) - 1] if len(leaves) else np.empty(0, np.int64)
    return Tree(root, raw[0], nodes & np.uint32(0x3FFFFFFF), (nodes >> np.uint32(30) & np.uint32(1)).astype(bool), (leaves >> np.uint32(6)).astype(np.uint64), leaves >> np.uint32(1) & RANK, of)


def _left(x: list, y: list) -> np.ndarray:
    """Of a few elements the same: each of x takes one of its value in y."""
    free: dict = {}
    for v in y:
        free[v] = free.get(v, 0) + 1
    out = np.zeros(len(x), bool)
    if free.keys() & set(x):
        for k, v in enumerate(x):
            if n := free.get(v):
                free[v] = n - 1
                out[k] = True
    return out


def _common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which elements have a partner in the other array, the k-th of a value with the k-th."""
    if len(a) + len(b) < 500:
        x, y = a.tolist(), b.tolist()
        return _left(x, y), _left(y, x)
    both = np.concatenate([a, b])
    if not len(both):
        return np.empty(0, bool), np.empty(0, bool)
    order = np.argsort(both, kind="stable")
    v, mine = both[order], order < len(a)
    starts = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    sizes = np.diff(np.append(starts, len(v)))
    n = np.add.reduceat(mine.astype(np.int64), starts)
    shared = np.repeat(np.minimum(n, sizes - n), sizes)
    place = np.arange(len(v)) - np.repeat(starts, sizes)
    hit = np.where(mine, place, place - np.repeat(n, sizes)) < shared
    out = np.empty(len(both), bool)
    out[order] = hit
    return out[: len(a)], out[len(a) :]


def likeness(a: Tree, b: Tree) -> float:
    """1 for equal roots; else the paragraphs and leaves in common over their mean number, by walking the branches that differ."""
    if a.root == b.root:
        return 1.0
    (x, p), (y, q) = a.sections(), b.sections()
    if a.level != b.level:
        level = max(a.level, b.level)
        a, b = a.raised(level), b.raised(level)
    size = len(a.nodes) + len(a.digest) + len(b.nodes) + len(b.digest)
    same = [np.repeat(hit, bounds[1:] - bounds[:-1]) for hit, bounds in zip(_common(x, y), (p, q))]
    rest = [np.flatnonzero(~s) for s in same]
    for s, r, hit in zip(same, rest, _common(a.nodes[rest[0]], b.nodes[rest[1]])):
        s[r[hit]] = True
    whole = sum(int(s.sum()) + int(s[t.of].sum()) for s, t in zip(same, (a, b)))
    left = [t.digest[~s[t.of]] for s, t in zip(same, (a, b))]
    parts = int(_common(*left)[0].sum()) if len(left[0]) and len(left[1]) else 0
    return (whole + 2 * parts) / size


def located(a: Tree, b: Tree) -> tuple[int, int, int, int] | None:
    """Where two trees differ: (first paragraph of a, end, first of b, end), ends exclusive; None for equal roots.

    Equal leading and trailing sections, then equal leading and trailing paragraphs of what is left, are passed over."""
    if a.root == b.root:
        return None

    def lead(x: np.ndarray, y: np.ndarray) -> int:
        n = min(len(x), len(y))
        differ = np.flatnonzero(x[:n] != y[:n])
        return int(differ[0]) if len(differ) else n

    (x, p), (y, q) = a.sections(), b.sections()
    front = lead(x, y)
    back = min(lead(x[::-1], y[::-1]), min(len(x), len(y)) - front)
    i, j, k, m = int(p[front]), int(p[len(x) - back]), int(q[front]), int(q[len(y) - back])
    u, v = a.nodes[i:j], b.nodes[k:m]
    inner = lead(u, v)
    outer = min(lead(u[::-1], v[::-1]), min(len(u), len(v)) - inner)
    return i + inner, j - outer, k + inner, m - outer


def compare(a: str, b: str) -> float:
    return likeness(parsed(a), parsed(b))


def locate(a: str, b: str) -> tuple[int, int, int, int] | None:
    return located(parsed(a), parsed(b))


def fingerprints(docs: DataFrame, most_leaves: int = 32, text: str = "text") -> DataFrame:
    """doc_id and fingerprint of each text."""

    def make():
        f = Fingerprints(most_leaves)
        return lambda texts: [(written(f.tree(x or b"")),) for x in texts]

    return common.rows_mapped(docs, make, "fingerprint string", text=text)


FIELDS = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edit_from_line", pa.int64()), ("edit_to_line", pa.int64()),
])
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edit_from_line long, edit_to_line long"
LEAST = -(1 << 63)  # null ids' place in the order


def _numbers(values: list[int]) -> Column:
    """A constant array of any length: one literal in the plan."""
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)")


def range_of(key: Column, h: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts lie before (key, h). A value that is cut k times has its rows split by h into k + 1 parts."""
    if not cuts:
        return F.lit(0).cast("long")
    values, counts = np.unique(np.array(cuts, np.int64), return_counts=True)
    before = np.append(0, np.cumsum(counts))
    step = max(1, int(len(values) ** 0.5))
    block = F.greatest(F.size(F.filter(_numbers(values[::step].tolist()), lambda x: x <= key)) - 1, F.lit(0)) * step
    at = block + F.size(F.filter(F.slice(_numbers(values.tolist()), block + 1, F.lit(step)), lambda x: x < key))
    n = F.when(F.get(_numbers(values.tolist()), at) == key, F.get(_numbers(counts.tolist()), at)).otherwise(0)
    part = F.shiftright((F.shiftright(h, 32) + F.lit(1 << 31)) * (n + 1), 32)
    return F.get(_numbers(before.tolist()), at) + part


def against_next(docs: DataFrame, rows_per_range: int = 4000, most_ranges: int = 100_000, most_leaves: int = 32) -> DataFrame:
    """Each document against its edited text and the next document by (doc_id, a hash of the text, text); after the last comes
    the first. edit_from_line and edit_to_line: the lines of the text where the edited one's tree differs (null: nowhere).

    Documents go to ranges of that order, cut at quantiles of the ids (which only size the ranges, so need not be exact; an id
    that is cut several times is split by the hash). The first row of each range is found first, and goes to the range before
    as well: each range, one partition, is then walked in order, one row in memory, and needs no other. Ranges grow in number
    with the rows; past most_ranges, a bound on what the driver holds, in size."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise ValueError("doc_id must be of an integer type")
    key = F.coalesce(F.col("doc_id"), F.lit(LEAST))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    parts = max(1, min(most_ranges, -(-docs.count() // rows_per_range)))
    cuts = docs.select(key.alias("key")).approxQuantile("key", [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else []
    placed = docs.withColumn("key", key).withColumn("h", F.xxhash64("text"))
    placed = placed.withColumn("range", range_of(F.col("key"), F.col("h"), sorted(int(c) for c in cuts)))
    firsts = sorted((r["range"], r["first"]["key"], r["first"]["h"]) for r in placed.groupBy("range").agg(F.min(F.struct("key", "h")).alias("first")).collect())
    turns = [(k, h, r, firsts[i - 1][0]) for i, (r, k, h) in enumerate(firsts)]
    again = docs.sparkSession.createDataFrame(turns, "key long, h long, range long, before long")
    rows = placed.join(F.broadcast(again), ["key", "h", "range"], "left").select("doc_id", "text", "key", "h", F.explode(F.when(F.col("before").isNull(), F.array(F.struct("range", F.lit(0).alias("turn")))).otherwise(F.array(F.struct("range", F.lit(0).alias("turn")), F.struct(F.col("before").alias("range"), F.lit(1).alias("turn"))))).alias("to"))
    rows = rows.select("doc_id", "text", "key", "h", "to.*")
    dealt = rows.repartitionById(parts, F.col("range").cast("int")).sortWithinPartitions("range", "turn", "key", "h", "text").select("doc_id", "text", "range", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Fingerprints(most_leaves)
        out: list[tuple] = []
        held = None  # (range, doc_id, text, tree)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                for doc, text, where, turn in zip(part.column("doc_id").to_pylist(), texts_of(part), part.column("range").to_pylist(), part.column("turn").to_pylist()):
                    mine = f.tree(text) if held or not turn else None
                    if held:
                        out.append(_row(f, held, text, mine))
                    held = None if turn else (where, doc, text, mine)
                if len(out) >= 200:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    return dealt.mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), FIELDS.types)], schema=FIELDS)


def _row(f: Fingerprints, held: tuple, text: bytes, following: Tree) -> tuple:
    _, doc, own, mine = held
    chars = own.decode()
    k = len(chars) // 4
    edited = (chars[: len(chars) - k] + text[: 4 * k].decode(errors="ignore")[:k]).encode()
    theirs = f.tree(edited)
    where = located(mine, theirs)
    return doc, len(chars), hashlib.sha256(edited).hexdigest(), written(mine), written(theirs), likeness(mine, theirs), likeness(mine, following), *((where[0], where[1]) if where else (None, None))


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    return against_next(common.table(spark, sf_dir, "documents"))
