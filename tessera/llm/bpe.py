"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string exactly one token ends its BPE encoding. A token t that ends the
prefix is that token if the last token u of what stands before t may precede it, that is if u's and
t's bytes together encode as (u, t). So one pass that stores the last token of each prefix encodes;
appending bytes goes on from the stored states, and after an edit only the states from the edit to
where they agree with the old ones again are computed.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare
from .text_kernel import run_positions

#: Distinct pieces whose tokens a worker remembers, twice: those in use lately, and those before them.
REMEMBERED = 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Bytes and rank of each token of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


class Vocabulary:
    """Tokens with the two tokens that each was merged from."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=0)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.token = {r: b for b, r in ranks.items()}
        self._automaton()
        self.size = {r: len(b) for b, r in ranks.items()}
        for rank in sorted(self.token):
            if len(self.token[rank]) > 1 and (pair := self._parts(self.token[rank], rank)):
                self.parts[rank] = pair
                self.merged[pair] = rank

    def _automaton(self) -> None:
        """Tells from byte to byte which tokens end there: a trie of the tokens, where each node knows its longest suffix that is a node.

        A node: the node after a byte, (length, token, whether it fits after a token) of its suffixes that are
        tokens, the longest first, and the suffix. What is known to fit is told by token, then by the one before.
        """
        self.fits: dict[int, dict[int, bool]] = {t: {} for t in self.token}
        self.remembers = 4_000_000
        leaf = {}.get
        self.root: list = [{}.get, (), None]
        level = [(b"", self.root)]
        words: list[list[bytes]] = [[] for _ in range(self.longest + 1)]
        for start in {word[:n] for word in self.ranks for n in range(1, len(word) + 1)}:
            words[len(start)].append(start)
        for starts in words[1:]:
            above, level = dict(level), []
            for word in starts:
                parent = above[word[:-1]]
                node = [leaf, (), self.root]
                if parent[0] is leaf:
                    parent[0] = {}.get
                parent[0].__self__[word[-1]] = node
                short = parent[2]
                while short is not None:
                    if (found := short[0](word[-1])) is not None:
                        node[2] = found
                        break
                    short = short[2]
                rank = self.ranks.get(word)
                node[1] = node[2][1] if rank is None else ((len(word), rank, self.fits[rank].get), *node[2][1])
                level.append((word, node))

    def _parts(self, word: bytes, rank: int) -> tuple[int, int] | None:
        """The last two tokens when only merges before rank are done."""
        own = [word[i : i + 1] for i in range(len(word))]
        while len(own) > 2:
            best, at = rank, -1
            for i in range(len(own) - 1):
                if (r := self.ranks.get(own[i] + own[i + 1], rank)) < best:
                    best, at = r, i
            if at < 0:
                return None
            own[at : at + 2] = [own[at] + own[at + 1]]
        return self.ranks[own[0]], self.ranks[own[1]]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether left's and right's bytes together encode as (left, right).

        Undoes merges on both sides of the seam, the latest first. If two tokens that faced each other
        there would have merged before what was undone, BPE would have crossed the seam.
        """
        told, after = self.fits[right], left
        if (known := told.get(after)) is not None:
            return known
        before, fits = sys.maxsize, True  # merges across the seam of a rank below before come first
        while True:
            if (across := self.merged.get((left, right))) is not None and across < before:
                fits = False
                break
            undo_left = self.parts.get(left), left
            undo_right = self.parts.get(right), right
            if undo_left[0] is None and undo_right[0] is None:
                break
            # of equal merges, the left one was done first, so the right one is undone first
            if undo_right[0] is None or (undo_left[0] is not None and left > right):
                before, left = left, undo_left[0][1]
            else:
                before, right = right + 1, undo_right[0][0]
        if self.remembers:
            self.remembers -= 1
            told[after] = fits
        return fits


class Prefixes:
    """A byte string with the last token of each of its prefixes, and where the automaton is after it."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last, self.nodes = vocabulary, b"", [-1], [vocabulary.root]
        self.append(data)

    def append(self, data: bytes) -> None:
        """Goes on from the stored states."""
        self.data += data
        self._extend(len(self.data))

    def _extend(self, upto: int) -> None:
        last, nodes, v = self.last, self.nodes, self.vocabulary
        end = len(last)
        node = nodes[-1]
        for byte in self.data[end - 1 : upto]:
            while (following := node[0](byte)) is None:
                node = node[2]
                if node is None:
                    raise ValueError("the vocabulary lacks a byte")
            node = following
            for n, t, fits in node[1]:
                u = last[end - n]
                if u < 0:
                    break
                ok = fits(u)
                if ok or (ok is None and v.may_follow(u, t)):
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            last.append(t)
            nodes.append(node)
            end += 1

    def become(self, data: bytes) -> None:
        """Another byte string: the states of the prefix that both share stay, the rest is appended."""
        old, n = self.data, min(len(self.data), len(data))
        same = 0
        while same < n and old[same] == data[same]:
            same += 1
        del self.last[same + 1 :], self.nodes[same + 1 :]
        self.data = data
        self._extend(len(data))

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replaces data[start:end]; returns how many states were computed anew."""
        old, nodes, shift = self.last, self.nodes, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last, self.nodes, same = old[: start + 1], nodes[: start + 1], 0
        while len(self.last) <= len(self.data):
            at = len(self.last)
            self._extend(at)
            was = at - shift
            same = same + 1 if was > end and old[was] == self.last[-1] else 0
            if same >= self.vocabulary.longest:  # a state depends on that many before it
                done = at - start
                self.last += old[was + 1 :]
                self.nodes += nodes[was + 1 :]
                return done
        return len(self.last) - 1 - start

    def tokens(self) -> list[int]:
        out, end, last, size = [], len(self.data), self.last, self.vocabulary.size
        while end:
            t = last[end]
            out.append(t)
            end -= size[t]
        out.reverse()
        return out


def _classes(limit: int) -> tuple[str, str]:
    of = lambda kind: "".join(map(re.escape, (c for c in map(chr, range(limit)) if unicodedata.category(c)[0] == kind)))
    return of("L"), of("N")


class Splitter:
    """Pieces of a text by a pattern with \\p{L}, \\p{N} and \\s.

    Texts of characters below U+0250 go through the same pattern with its classes spelled out for the
    faster engine; \\s is Unicode white space in both.
    """

    SIMPLE = 0x250
    SPACE = "\t\n\x0b\x0c\r \x85\xa0"

    def __init__(self, pattern: str):
        self.full = regex.compile(re.sub(r"\\s", r"\\p{White_Space}", re.sub(r"\\S", r"\\P{White_Space}", pattern)))
        letters, numbers = _classes(self.SIMPLE)
        self.simple = None
        probe = re.sub(r"\\p\{[LN]\}|\\s|\\S", "", pattern)
        if not re.search(r"\\[a-zA-Z]|\(\?[^!:=]", probe):
            spelled, inside = "", False
            for part in re.split(r"(\\p\{[LN]\}|\\s|\\S|\\.|\[|\])", pattern):
                if part in ("[", "]"):
                    inside = part == "["
                known = {r"\p{L}": letters, r"\p{N}": numbers, r"\s": self.SPACE}.get(part)
                if part == r"\S":
                    known = None if inside else f"[^{self.SPACE}]"
                    spelled += known or part
                else:
                    spelled += part if known is None else known if inside else f"[{known}]"
            self.simple = re.compile(spelled)
        self.plain = re.compile(f"[\x00-{chr(self.SIMPLE - 1)}]*")

    def __call__(self, text: str) -> list[str]:
        if self.simple and self.plain.fullmatch(text):
            return self.simple.findall(text)
        return self.full.findall(text)


def _encoder(ranks: bytes, pattern: str):
    """A worker's function from texts to their ids' bytes (int32)."""
    vocabulary = Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())})
    split = Splitter(pattern)
    young: dict[str, bytes] = {}
    old: dict[str, bytes] = {}

    def encode(texts: list[str | None]) -> list[bytes]:
        """Each text's ids. Pieces that aren't remembered are encoded in sorted order, so that each goes on from the prefix it shares with the one before."""
        nonlocal young, old
        pieces = [split(t) if t else [] for t in texts]
        if len(young) >= REMEMBERED:
            young, old = {}, young
        new = []
        for p in set().union(*pieces).difference(young):
            if (ids := old.get(p)) is None:
                new.append((p.encode(), p))
            else:
                young[p] = ids
        new.sort()
        states = Prefixes(vocabulary)
        for data, p in new:
            whole = vocabulary.ranks.get(data)
            if whole is not None and (len(data) == 1 or whole in vocabulary.parts):
                tokens = [whole]
            else:
                states.become(data)
                tokens = states.tokens()
            young[p] = array("i", tokens).tobytes()
        known = young.__getitem__
        out = [b"".join(map(known, own)) for own in pieces]
        for data, p in new:
            if len(data) > 64:  # long ones don't come again
                del young[p]
        return out

    return encode


_encoders: dict[tuple[int, int, str], object] = {}
#: Texts that are Python objects at a time.
ENCODED = 512


class _Decoder:
    """Bytes of token ids, from the vocabulary laid out one token after another."""

    def __init__(self, ranks: dict[bytes, int]):
        token = {r: b for b, r in ranks.items()}
        size = max(token, default=-1) + 1
        self.lengths = np.array([len(token.get(r, b"")) for r in range(size)], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.every = np.frombuffer(b"".join(token.get(r, b"") for r in range(size)), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        return self.every[np.repeat(self.starts[ids], n) + run_positions(n)].tobytes()


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), decoded: bool = False) -> DataFrame:
    """One row per document: id, (columns to keep, as kept_<name>), ids array<int>(, decoded binary).

    Each match of the pattern is encoded by itself, without special tokens. Null and empty texts have
    no ids. Rows that repeat, or have no id, give as many rows; an empty table none. The rank file is
    read by the driver and sent to the workers. decoded: adds the ids' bytes, one after another, as decode
    does, in the same pass.
    """
    prepare(docs.sparkSession)
    held = load_ranks(rank_file)
    ranks = b"\n".join(base64.b64encode(b) + b" %d" % r for b, r in held.items())
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary: a fixed size
    tables = docs.sparkSession.sparkContext.broadcast(_Decoder(held)) if decoded else None
    key = (len(ranks), hash(ranks), pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _encoders:  # a worker process builds it once
            _encoders.clear()
            _encoders[key] = _encoder(shared.value, pattern)
        one = _encoders[key]
        for batch in batches:
            for a in range(0, batch.num_rows, ENCODED):
                part = batch.slice(a, ENCODED)
                found = one(part.column(0).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in found])]).astype(np.int32)
                out = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))]
                if tables is not None:
                    out.append(pa.array([tables.value(np.frombuffer(p, np.int32).astype(np.int64)) for p in found], pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *out], [*part.schema.names[1:], "ids", "decoded"][: part.num_columns + len(out) - 1])

    kept = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col), *(F.col(f"`{c}`").alias(f"kept_{c}") for c in keep))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:])
    return kept.mapInArrow(run, f"{schema}, ids array<int>" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, rank_file: str, ids_col: str = "ids") -> DataFrame:
    """The rows with a binary column decoded: the ids' bytes, one after another. Null ids give no bytes."""
    prepare(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(_Decoder(load_ranks(rank_file)))  # the vocabulary: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            out = [shared.value(x.values.to_numpy(zero_copy_only=False).astype(np.int64)) if x.is_valid else b"" for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{schema}, decoded binary")
