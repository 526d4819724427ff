"""SentencePiece encoding and decoding: a score-ordered agenda of adjacent symbol pairs for merge-type vocabularies.

The text, with spaces written as the meta symbol and one put in front, falls into segments that no piece of the vocabulary
crosses; this is checked against the vocabulary when it is loaded, and where it does not hold a text is one segment. Merges
in one segment cannot touch another, so each distinct segment is encoded once per worker and remembered (the memory is
emptied at a bound). Each Arrow batch's new segments are compared with the sentencepiece library's own ids.

Null and empty texts: the end id alone, decoded to an empty text. Very long texts are encoded whole. Of pairs with equal scores the
leftmost is merged first, as the library does. Repeated rows give equal rows, an empty table an empty result. Extra columns are
not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
from pyspark.sql import DataFrame

from . import common
from .common import rows_mapped, shipped, vocabulary_bytes
from .lookup import Lookup

shipped(__name__)
META = "▁"
PLACE, GONE, NEVER, SHORT = (1 << 40) - 1, -2, 1 << 40, 32


class Codec:
    """ids(segment) by the agenda; text(ids) by pieces."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        every = range(sp.get_piece_size())
        self.name = [sp.id_to_piece(i) for i in every]
        self.byte = {i: int(self.name[i][3:5], 16) for i in every if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte.items()}
        special = {i for i in every if sp.is_control(i) or sp.is_unknown(i)} | set(self.byte)
        self.shown = [x.replace(META, " ") for x in self.name]
        self.silent = {i for i in every if sp.is_control(i)}
        self.id = {self.name[i]: i for i in every if i not in special}
        self.symbol = {p: i for p, i in self.id.items() if len(p) == 1}
        scores = {p: sp.get_score(i) for p, i in self.id.items()}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        #: pair of ids -> (place on the agenda, id of the merged piece); the symbol's own place is added to the former.
        self.merge = {self.id[p[:k]] << 20 | self.id[p[k:]]: (order[scores[p]] << 40, i) for p, i in self.id.items() for k in range(1, len(p)) if p[:k] in self.id and p[k:] in self.id}
        self.end, self.unknown = sp.eos_id(), sp.unk_id()
        crossed = any(re.search(f"[^{META}]{META}", p) for p in self.id)
        lines = not any("\n" in p for p in self.id)
        self.segment = re.compile(".+" if crossed else f"{META}+[^{META}\n]*|[^{META}\n]+|\n" if lines else f"{META}*[^{META}]+|{META}+", re.S)

        pairs = list(self.merge)
        self.find = Lookup(np.array(pairs, np.uint64))
        self.places = np.array([*(self.merge[k][0] >> 40 for k in pairs), NEVER], np.int64)
        self.merged = np.array([*(self.merge[k][1] for k in pairs), -1], np.int64)
        self.by_code = np.full(0x110000, -1, np.int64)
        for x, i in self.symbol.items():
            self.by_code[ord(x)] = i

    def segments(self, text: str) -> list[str]:
        return self.segment.findall(META + text.replace(" ", META)) if text else []

    def encode_segment(self, segment: str) -> list[int]:
        ids = [self.symbol.get(x, -1) for x in segment]
        n, merge = len(ids), self.merge.get
        after = [*range(1, n), -1]
        agenda = [m[0] | i for i in range(n - 1) if (m := merge(ids[i] << 20 | ids[i + 1])) is not None]
        if agenda:
            before = list(range(-1, n - 1))
            heapq.heapify(agenda)
            while agenda:
                top = heapq.heappop(agenda)
                left = top & PLACE
                right = after[left]
                if right < 0 or ids[left] < 0 or (m := merge(ids[left] << 20 | ids[right])) is None or m[0] | left != top:
                    continue  # one of the two has been merged meanwhile
                ids[left], ids[right] = m[1], GONE
                after[left] = last = after[right]
                after[right] = -1
                if last >= 0:
                    before[last] = left
                    if (m := merge(ids[left] << 20 | ids[last])) is not None:
                        heapq.heappush(agenda, m[0] | left)
                if (first := before[left]) >= 0 and (m := merge(ids[first] << 20 | ids[left])) is not None:
                    heapq.heappush(agenda, m[0] | first)
        if -1 not in ids:
            return [i for i in ids if i != GONE]
        out: list[int] = []
        for i, x in zip(ids, segment):
            if i >= 0:
                out.append(i)
            elif i == -1:
                out.extend([self.byte_id[b] for b in x.encode()] if self.byte_id else [self.unknown])
        return out

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        """As encode_segment. Short segments go through their agendas in lockstep: each row of a matrix holds one segment's
        symbols, another the places of its pairs on the agenda; in each round every segment makes its first merge."""
        out: list = [None] * len(segments)
        if not self.byte_id and self.unknown < 0:
            return [self.encode_segment(s) for s in segments]
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        for k in np.flatnonzero(sizes > SHORT):
            out[k] = self.encode_segment(segments[k])
        for low, high in ((0, 8), (8, 16), (16, SHORT)):
            if len(chosen := np.flatnonzero((sizes > low) & (sizes <= high))):
                for k, ids in zip(chosen.tolist(), self.lockstep([segments[k] for k in chosen], sizes[chosen], high)):
                    out[k] = ids if -1 not in ids else self.encode_segment(segments[k])
        return out

    def lockstep(self, segments: list[str], sizes: np.ndarray, width: int) -> list[list[int]]:
        symbols = np.full((len(segments), width + 1), GONE, np.int64)
        symbols[np.arange(width + 1) < sizes[:, None]] = self.by_code[np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)]
        place, _ = self.looked_up(symbols[:, :-1], symbols[:, 1:])
        rows = np.arange(len(segments))
        steps = np.arange(width + 1)
        work, at = symbols, place
        while len(rows):
            best = at.argmin(1)
            live = at[np.arange(len(rows)), best] < NEVER
            if not live.all():
                symbols[rows[~live]] = work[~live]
                rows, work, at, best = rows[live], work[live], at[live], best[live]
                if not len(rows):
                    break
            every = np.arange(len(rows))
            _, merged = self.looked_up(work[every, best], work[every, best + 1])
            padded = np.concatenate([work, np.full((len(rows), 1), GONE)], 1)
            work = np.take_along_axis(padded, steps + (steps > best[:, None]), 1)
            work[every, best] = merged
            at = np.take_along_axis(np.concatenate([at, np.full((len(rows), 1), NEVER)], 1), steps[:-1] + (steps[:-1] > best[:, None]), 1)
            at[every, best], _ = self.looked_up(work[every, best], work[every, best + 1])
            if len(inner := np.flatnonzero(best > 0)):
                b = best[inner]
                at[inner, b - 1], _ = self.looked_up(work[inner, b - 1], work[inner, b])
        left = (symbols != GONE).sum(1).tolist()
        return [row[:n] for row, n in zip(symbols.tolist(), left)]

    def looked_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places on the agenda of pairs of ids (NEVER: no such merge) and the merged ids."""
        k = self.find(np.where((a | b) >= 0, a << 20 | b, (1 << 60) + 1).astype(np.uint64))
        return self.places[k], self.merged[k]

    def encode(self, text: str | None) -> list[int]:
        """All ids of a text, the end id last."""
        return [i for s in self.segments(text or "") for i in self.encode_segment(s)] + [self.end]

    def decode_segment(self, ids: list[int]) -> str:
        if self.byte.keys().isdisjoint(ids) and self.silent.isdisjoint(ids):
            return "".join([self.shown[i] for i in ids])
        out = bytearray()
        for i in ids:
            if i in self.byte:
                out.append(self.byte[i])
            elif i not in self.silent:
                out += self.name[i].replace(META, " ").encode()
        return out.decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that encoding puts in front goes."""
        return self.decode_segment(ids).removeprefix(" ")

    def library_ids(self, segments: list[str]) -> list[list[int]]:
        """The library's ids of segments, each in a place where it stands as in a text."""
        inside = [x[1:].replace(META, " ") if x[0] == META and len(x) > 1 else "\n" + x.replace(META, " ") for x in segments]
        skip = [0 if x[0] == META and len(x) > 1 else 2 for x in segments]
        return [ids[k:] for ids, k in zip(self.library.encode(inside, num_threads=1), skip)]


class Remembered:
    """Segment -> (number of ids, ids as text, decoded text, as the library has it)."""

    def __init__(self, model: bytes, bound: int):
        self.codec, self.bound, self.known = Codec(model), bound, {}
        self.digits = list(map(str, range(len(self.codec.name))))

    def learn(self, new: list[str]) -> None:
        c = self.codec
        for s, ids, theirs in zip(new, c.encode_segments(new), c.library_ids(new)):
            self.known[s] = (len(ids), " ".join([self.digits[i] for i in ids]), c.decode_segment(ids), ids == theirs)

    def digests(self, texts: list[bytes | None]) -> list[tuple[int, str, str, bool]]:
        split = [self.codec.segments((x or b"").decode()) for x in texts]
        if new := {s for segments in split for s in segments} - self.known.keys():
            if len(self.known) + len(new) > self.bound:
                self.known.clear()
                new = {s for segments in split for s in segments}
            self.learn(list(new))
        return [self.digest(segments) for segments in split]

    def digest(self, segments: list[str]) -> tuple[int, str, str, bool]:
        parts = [self.known[s] for s in segments]
        ids = " ".join([*(p[1] for p in parts), str(self.codec.end)])
        decoded = "".join([p[2] for p in parts]).removeprefix(" ")
        return 1 + sum(p[0] for p in parts), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), all(p[3] for p in parts)


def encoded(docs: DataFrame, model_path: str | None = None, text: str = "text") -> DataFrame:
    """doc_id and ids array<int> (the end id last) of each text."""
    from pyspark.sql import functions as F

    model = vocabulary_bytes(model_path)

    def make():
        c = Codec(model)
        return lambda texts: [(c.encode((x or b"").decode()),) for x in texts]

    return rows_mapped(docs, make, "ids array<long>", text=text).withColumn("ids", F.col("ids").cast("array<int>"))


def digests(docs: DataFrame, model_path: str | None = None, bound: int = 400_000, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and library_agrees of each text.

    bound: segments that a worker remembers."""
    model = vocabulary_bytes(model_path)
    return rows_mapped(docs, lambda: Remembered(model, bound).digests, "n_tokens long, ids_sha256 string, decoded_sha256 string, library_agrees boolean", text=text)


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))
