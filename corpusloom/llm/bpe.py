"""Byte-level BPE as a streaming transducer with bounded lookahead.

``Merges`` holds a merge list and its sufficient lookahead K: bytes more than K
beyond a token's end can't change that token. ``Transducer`` reads texts in chunks
and emits ids once they are stable: those of a pre-token that is closed, and of one
that is still open those that end K bytes before its end, as soon as it fills a
window. A ``Stream`` is all that a text leaves open between two chunks: a few
hundred characters and one window of bytes. Many texts go through at once, so closed
pre-tokens are merged as vectors, and those seen before come from a bounded memo.
``TextMachine`` turns token bytes back into text, holding at most the three bytes of
an unfinished character.

Why K is finite. In a merge list from training, a rule ranks after the rules
that made its two sides, so the ranks of applied merges never fall. What happens
right of a token reaches it only by a chain of rules, each consuming the left
part of the next, with strictly falling ranks from left to right. The longest
such chain, in bytes, is computed once by dynamic programming over the list.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from bisect import bisect_left
from codecs import getincrementaldecoder
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import slices

#: The white space of pre-tokenization (Unicode White_Space).
WHITE = frozenset(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Letters and digits that Unicode 16.0 added, for older character tables.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
DIGITS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
_LATE = {chr(p): kind for kind, spans in (("L", LETTERS_16), ("N", DIGITS_16)) for a, b in spans for p in range(a, b + 1)}
#: Below this code point the small pattern holds, which is faster than that of all characters.
SMALL_TOP = 0x500
BEYOND = re.compile(f"[^\x00-{chr(SMALL_TOP - 1)}]")
#: Characters of an open pre-token or tail from which it goes through the window, and of the longest unit in the memo.
OPEN_CHARS, MEMO_CHARS = 512, 256
#: Bytes of texts that go through together, and of one chunk of a longer text.
GROUP_BYTES, CHUNK_BYTES = 4 << 20, 1 << 18
NO_IDS = np.zeros(0, dtype="<u4")


def char_kind(c: str) -> str:
    """L, N, s (white space) or o."""
    if c in WHITE:
        return "s"
    kind = _LATE.get(c) or unicodedata.category(c)[0]
    return kind if kind in "LN" else "o"


class Patterns:
    """The pre-token pattern of this family of tokenizers and the runs of each kind, for characters below ``top``."""

    def __init__(self, top: int):
        sets = dict.fromkeys("LNso", "")
        for kind, points in groupby(map(chr, range(top)), char_kind):
            first = last = next(points)
            for last in points:
                pass
            sets[kind] += re.escape(first) if first == last else f"{re.escape(first)}-{re.escape(last)}"
        letters, digits, white, other = f"[{sets['L']}]", f"[{sets['N']}]", f"[{sets['s']}]", f"[^{sets['s']}{sets['L']}{sets['N']}]"
        self.findall = re.compile(f"'(?:[stmd]|re|ve|ll)| ?{letters}+| ?{digits}+| ?{other}+|{white}+(?![^{sets['s']}])|{white}+").findall
        self.runs = {"L": re.compile(letters + "*"), "N": re.compile(digits + "*"), "s": re.compile(white + "*"), "o": re.compile(other + "*")}


@lru_cache(maxsize=2)
def patterns(top: int) -> Patterns:
    return Patterns(top)


def patterns_for(text: str) -> Patterns:
    return patterns(0x110000 if not text.isascii() and BEYOND.search(text) else SMALL_TOP)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else spare))
        spare += b not in shown
    return out


class Merges:
    """A vocabulary, its ranked merges and the sufficient lookahead."""

    def __init__(self, tokens: dict[int, bytes], merges: list[tuple[int, int, int]], special: dict[str, int]):
        self.tokens, self.special = tokens, special
        self.rank = {(u, v): rank for rank, (u, v, _) in reversed(list(enumerate(merges)))}
        self.made = [t for _, _, t in merges]
        self.byte_ids = [0] * 256
        for i, b in tokens.items():
            if len(b) == 1:
                self.byte_ids[b[0]] = i
        self.longest = max(map(len, tokens.values()), default=1)
        keys = np.array([u << 32 | v for u, v, _ in merges], dtype=np.int64)
        self._order = np.argsort(keys, kind="stable")
        self._keys = np.append(keys[self._order], np.iinfo(np.int64).max)
        self._made = np.array([*self.made, 0], dtype=np.int32)
        self._rank = np.append(self._order, 0).astype(np.int32)
        self._bytes = np.array(self.byte_ids, dtype=np.int32)
        base = self._bytes.astype(np.int64)
        self._pairs = self._ranks(np.repeat(base, 256), np.tile(base, 256)).reshape(256, 256)
        self.lookahead = self._lookahead(merges)
        self.window = 4 * (self.lookahead + self.longest)

    @classmethod
    def load(cls, path: str) -> Merges:
        """From a byte-level BPE file in the JSON form of public tokenizers."""
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        back = {c: b for b, c in enumerate(byte_letters())}
        vocab = file["model"]["vocab"]
        special = {x["content"]: x["id"] for x in file.get("added_tokens", ())}
        tokens = {i: bytes(back[c] for c in text) for text, i in vocab.items() if text not in special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"])
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        return cls(tokens | {i: s.encode() for s, i in special.items()}, merges, special)

    def _lookahead(self, merges: list[tuple[int, int, int]]) -> int:
        """The most bytes beyond a token's end that can still change it.

        reach[t]: bytes that can disturb the making of t from the right. For each
        left side u: the ranks of its rules so far and the running maximum of
        (bytes of the right side + its reach). A list in which a rule comes before
        the rules that make its sides, or makes what another has made, is refused:
        its ranks could fall, and no bound would hold.
        """
        known = set(self.byte_ids)
        reach: dict[int, int] = {}
        ranks: dict[int, list[int]] = {}
        most: dict[int, list[int]] = {}
        for rank, (u, v, t) in enumerate(merges):
            if u not in known or v not in known or t in known:
                raise ValueError(f"merge rule {rank} is out of order: the lookahead has no bound")
            known.add(t)
            k = bisect_left(ranks.get(v, []), rank)
            reach[t] = max(reach.get(v, 0), most[v][k - 1] if k else 0)
            need = len(self.tokens[v]) + reach[t]  # whether v comes about, and isn't taken from the right before
            seen = most.setdefault(u, [])
            seen.append(max(need, seen[-1] if seen else 0))
            ranks.setdefault(u, []).append(rank)
        return max((m[-1] for m in most.values()), default=0)

    def _ranks(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Ranks of many pairs; as many as there are rules where there is none."""
        keys = u.astype(np.int64) << 32 | v
        at = np.searchsorted(self._keys, keys)
        return np.where(self._keys[at] == keys, self._rank[at], np.int32(len(self.made)))

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """``merge`` of many short pre-tokens at once, as little-endian 32-bit ids.

        Pieces of like length form a matrix; each round merges the best pair of
        every row that still has one, so the rounds are as many as the bytes.
        """
        out = [b""] * len(pieces)
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        none, low = len(self.made), 0
        for width in (4, 8, 12, 16, 24, 40):
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for some in np.array_split(rows, -(-len(rows) // 20_000)) if len(rows) else ():
                flat = np.zeros((len(some), width), dtype=np.uint8)
                inside = np.arange(width) < sizes[some][:, None]
                flat[inside] = np.frombuffer(b"".join([pieces[r] for r in some]), dtype=np.uint8)
                ids = np.where(inside, self._bytes[flat], np.int32(-1))
                rank = np.where(inside[:, 1:], self._pairs[flat[:, :-1], flat[:, 1:]], np.int32(none))
                done, live, cols = ids.copy(), np.arange(len(some)), np.arange(width)
                while len(live):
                    k = rank.argmin(axis=1)
                    best = rank[np.arange(len(live)), k]
                    on = best < none
                    if not on.all():
                        done[live[~on]] = ids[~on]
                        live, ids, rank, k, best = live[on], ids[on], rank[on], k[on], best[on]
                    if not len(live):
                        break
                    at, moved = np.arange(len(live)), cols[:-1] >= k[:, None]
                    later = ids[:, 1:].copy()
                    ids[:, -1] = -1
                    np.copyto(ids[:, 1:-1], later[:, 1:], where=moved[:, :-1])
                    later = rank[:, 1:].copy()
                    np.copyto(rank[:, :-1], later, where=moved[:, :-1])
                    rank[:, -1] = none
                    t = self._made[best]
                    ids[at, k] = t
                    left = np.flatnonzero(k)
                    rank[left, k[left] - 1] = self._ranks(ids[left, k[left] - 1], t[left])
                    right = np.flatnonzero((k + 1 < width) & (ids[at, np.minimum(k + 1, width - 1)] >= 0))
                    rank[right, k[right]] = self._ranks(t[right], ids[right, k[right] + 1])
                counts = (done >= 0).sum(axis=1)
                packed = done[done >= 0].astype("<u4").tobytes()
                ends = (np.cumsum(counts) * 4).tolist()
                for r, a, b in zip(some.tolist(), [0, *ends], ends):
                    out[r] = packed[a:b]
        for r in np.flatnonzero(sizes > low).tolist():
            window = bytearray(pieces[r])
            out[r] = np.array(self.settled(window) + self.merge(bytes(window)), dtype="<u4").tobytes()
        return out

    def settled(self, window: bytearray) -> list[int]:
        """Ids that no later byte can change, while the window is full; their bytes leave it."""
        out: list[int] = []
        while len(window) >= self.window:
            end, stable = 0, self.window - self.lookahead
            for i in self.merge(bytes(window[: self.window])):
                if end + len(self.tokens[i]) > stable:
                    break
                end += len(self.tokens[i])
                out.append(i)
            del window[:end]
        return out

    def merge(self, data: bytes) -> list[int]:
        """Token ids of one pre-token: the lowest rank first, the leftmost of equals."""
        ids = [self.byte_ids[b] for b in data]
        if len(ids) > 48:
            return self._merge_long(ids)
        rank, made, none = self.rank, self.made, len(self.made)
        found = [rank.get(p, none) for p in zip(ids, ids[1:])]
        last = len(found)
        while last:
            best = min(found)
            if best == none:
                break
            k = found.index(best)
            t = ids[k] = made[best]
            del ids[k + 1], found[k]
            last -= 1
            if k:
                found[k - 1] = rank.get((ids[k - 1], t), none)
            if k < last:
                found[k] = rank.get((t, ids[k + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list, for windows and long pre-tokens."""
        n, rank, made = len(ids), self.rank, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        live = [True] * n
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := rank.get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, u, v = heapq.heappop(heap)
            t = made[r]
            j = after[k]
            if not live[k] or j >= n or ids[k] != u or ids[j] != v:
                continue
            ids[k], live[j], after[k] = t, False, after[j]
            if after[k] < n:
                before[after[k]] = k
                if (r := rank.get((t, ids[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k, t, ids[after[k]]))
            if (i := before[k]) >= 0 and (r := rank.get((ids[i], t))) is not None:
                heapq.heappush(heap, (r, i, ids[i], t))
        return [x for x, keep in zip(ids, live) if keep]


class Stream:
    """What a text leaves open between two chunks."""

    def __init__(self):
        self.tail = ""  # characters that may yet belong to other pre-tokens
        self.kind, self.window = "", bytearray()  # of a long open pre-token: its kind and its last bytes


class Transducer:
    """Chunks of texts in, stable ids out; what it holds doesn't grow with the texts.

    A space that no white space follows starts a pre-token, whatever comes before
    it, so texts fall into units there. Of the texts that come together each distinct
    unit is taken apart once; pre-tokens are merged once as long as the memo keeps
    them, which has two generations of ``limit`` each.
    """

    def __init__(self, merges: Merges, limit: int = 400_000):
        self.merges, self.limit = merges, limit
        self.pretokens: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        names = sorted(merges.special, key=len, reverse=True)
        self.names = re.compile("|".join(map(re.escape, names))) if names else None
        self.halves = sorted({n[:k] for n in names for k in range(1, len(n))}, key=len, reverse=True)

    def feed(self, streams: list[Stream], chunks: list[str], last: list[bool]) -> list[np.ndarray]:
        """The ids that the next chunk of each stream has made stable; all that is left with its last."""
        plans = [self._plan(s, s.tail + chunk, end) for s, chunk, end in zip(streams, chunks, last)]
        merged = iter(self._texts([x for plan in plans for x in plan if isinstance(x, str)]))
        found = [[next(merged) if isinstance(x, str) else x for x in plan] for plan in plans]
        return [parts[0] if len(parts) == 1 else np.concatenate([NO_IDS, *parts]) for parts in found]

    def encode(self, chunks: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of one text that comes in chunks, as they become stable."""
        stream = Stream()
        for chunk in chunks:
            yield self.feed([stream], [chunk], [False])[0]
        yield self.feed([stream], [""], [True])[0]

    def rows(self, batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, bool]]:
        """(part of the batch, row in it, ids, whether the row ends) over whole texts; nulls are empty."""
        for part in slices([batch], at, 2048, GROUP_BYTES):
            column = part.column(at)
            if len(column) > 1 or column.nbytes <= CHUNK_BYTES:
                texts = [t or "" for t in column.to_pylist()]
                for k, ids in enumerate(self.feed([Stream() for _ in texts], texts, [True] * len(texts))):
                    yield part, k, ids, True
            else:
                yield from ((part, 0, ids, end) for ids, end in self._long(column[0]))

    def _long(self, text: pa.Scalar) -> Iterator[tuple[np.ndarray, bool]]:
        stream, machine, data = Stream(), getincrementaldecoder("utf-8")(), memoryview(text.as_buffer() or b"")
        for at in range(0, len(data), CHUNK_BYTES):
            end = at + CHUNK_BYTES >= len(data)
            yield self.feed([stream], [machine.decode(data[at : at + CHUNK_BYTES], end)], [end])[0], end
        if not len(data):
            yield NO_IDS, True

    def _plan(self, s: Stream, text: str, last: bool) -> list:
        """Ids and closed texts, in order, of all that is stable in ``text``; the rest goes to the stream."""
        parts: list = []
        while self.names and (m := self.names.search(text)):  # the names of special tokens give their ids
            self._segment(s, text[: m.start()], True, parts)
            parts.append(np.array([self.merges.special[m[0]]], dtype="<u4"))
            text = text[m.end() :]
        half = "" if last else next((h for h in self.halves if text.endswith(h)), "")
        self._segment(s, text[: len(text) - len(half)], last, parts)
        s.tail += half
        return parts

    def _segment(self, s: Stream, text: str, last: bool, parts: list) -> None:
        s.tail = ""
        if s.kind:  # a long pre-token is open
            end = patterns_for(text).runs[s.kind].match(text).end()
            whole = end == len(text)
            upto = end - 1 if s.kind == "s" and not (last and whole) else end  # the last white space belongs to what follows
            s.window += text[:upto].encode("utf-8", "surrogatepass")
            parts.append(np.array(self.merges.settled(s.window), dtype="<u4"))
            text = text[upto:]
            if whole and not last:
                s.tail = text
                return
            parts.append(np.array(self.merges.merge(bytes(s.window)), dtype="<u4"))
            s.kind, s.window = "", bytearray()
        if last:
            parts += [text] if text else []
            return
        cut = _safe_cut(text)
        parts += [text[:cut]] if cut else []
        tail = text[cut:]
        if len(tail) > OPEN_CHARS:
            pieces = patterns_for(tail).findall(tail)
            open_ones = 2 if pieces[-2:-1] == ["'"] and len(pieces[-1]) == 1 else 1  # it may become a contraction
            parts.append(np.frombuffer(b"".join(self._pieces(pieces[:-open_ones])), dtype="<u4"))
            tail = "".join(pieces[-open_ones:])
            if len(tail) > OPEN_CHARS:
                s.kind = char_kind(tail[-1])
                upto = len(tail) - (s.kind == "s")
                s.window += tail[:upto].encode("utf-8", "surrogatepass")
                parts.append(np.array(self.merges.settled(s.window), dtype="<u4"))
                tail = tail[upto:]
        s.tail = tail

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids (little-endian 32-bit) of closed pre-tokens; new ones are merged together."""
        distinct = set(pieces)
        new = distinct.difference(self.pretokens)
        again = new.intersection(self.older)
        self.pretokens.update((p, self.older.pop(p)) for p in again)
        new = list(new - again)
        self.pretokens.update(zip(new, self.merges.merge_many([p.encode("utf-8", "surrogatepass") for p in new])))
        found = list(map(self.pretokens.__getitem__, pieces))
        for p in new:
            if len(p) > MEMO_CHARS:
                del self.pretokens[p]
        if len(self.pretokens) > self.limit:  # what the next ones don't use is given up
            self.older, self.pretokens = self.pretokens, {}
        return found

    def _units(self, units: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """Ids of the pre-tokens of all units, and how many of them belong to each unit.

        Every unit has lost its space, and no white space starts it, so joined by
        spaces they are one text with the same pre-tokens.
        """
        if not len(units):
            return [], np.zeros(0, dtype=np.int64)
        text = " " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(units)], pa.int32()), units.cast(pa.string())), " ")[0].as_py()
        pieces = patterns_for(text).findall(text)
        ends = np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))
        upto = np.searchsorted(ends, np.cumsum(pc.utf8_length(units).to_numpy(zero_copy_only=False).astype(np.int64) + 1)) + 1
        return self._pieces(pieces), np.diff(upto, prepend=0)

    def _texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of closed texts. Units are told apart by Arrow, so each distinct one is taken apart once."""
        if not texts:
            return []
        heads = [t.partition(" ") for t in texts]
        lists = pc.split_pattern(pa.array([h[2] if h[1] else None for h in heads], type=pa.large_string()), " ")
        codes = pc.dictionary_encode(pc.list_flatten(lists))
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        kinds, at = codes.dictionary, codes.indices.to_numpy(zero_copy_only=False)
        leads = pc.dictionary_encode(pc.utf8_slice_codeunits(kinds, 0, 1))
        white = np.array([not c or c.isspace() for c in leads.dictionary.to_pylist()], dtype=bool)
        bad = white[leads.indices.to_numpy(zero_copy_only=False)]
        groups = [np.flatnonzero(~bad)]  # the slower pattern takes only the units that need it
        if not all(t.isascii() for t in texts):
            rare = pc.match_substring_regex(kinds, f"[^\\x{{0}}-\\x{{{SMALL_TOP - 1:x}}}]").to_numpy(zero_copy_only=False)
            groups = [np.flatnonzero(~bad & ~rare), np.flatnonzero(~bad & rare)]
        known, owners = [], []
        for some in groups:
            ids, pieces = self._units(kinds.take(pa.array(some)))
            known += ids
            owners.append(np.repeat(some, pieces))
        lengths = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        counts = np.bincount(np.concatenate(owners), weights=lengths, minlength=len(kinds)).astype(np.int64)
        order = np.concatenate(groups)  # units as their ids lie in flat
        opens = np.zeros(len(kinds), dtype=np.int64)
        opens[order] = np.cumsum(counts[order]) - counts[order]
        flat = np.frombuffer(b"".join(known), dtype="<u4")
        each = counts[at]
        upto = np.concatenate([[0], np.cumsum(each)])
        body = flat[np.repeat(opens[at] - upto[:-1], each) + np.arange(upto[-1])]
        cuts = upto[np.concatenate([[0], ends])]
        # White space after a space: such texts are taken apart whole.
        clumsy = set(np.searchsorted(ends, np.flatnonzero(bad[at]), side="right").tolist()) if bad.any() else set()
        alone = [t if k in clumsy else head for k, (t, (head, _, _)) in enumerate(zip(texts, heads))]
        parts = [patterns_for(t).findall(t) for t in alone]
        ids = iter(self._pieces([p for part in parts for p in part]))
        out = []
        for k, part in enumerate(parts):
            first = np.frombuffer(b"".join([next(ids) for _ in part]), dtype="<u4")
            out.append(first if k in clumsy else np.concatenate([first, body[cuts[k] : cuts[k + 1]]]))
        return out


def _safe_cut(text: str) -> int:
    """Where the last unit of a text starts."""
    k = text.rfind(" ", 0, max(0, len(text) - 1))
    while k > 0 and text[k + 1].isspace():
        k = text.rfind(" ", 0, k)
    return max(k, 0)


class TextMachine:
    """Token bytes in, text out; malformed bytes give U+FFFD as in lossy UTF-8."""

    def __init__(self):
        self.machine = getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes) -> str:
        return self.machine.decode(data)

    def finish(self) -> str:
        return self.machine.decode(b"", True)


class ByteTable:
    """Bytes of every id in one buffer, so that many ids are spelt at once."""

    def __init__(self, merges: Merges):
        table = [merges.tokens.get(i, b"") for i in range(max(merges.tokens, default=0) + 1)]
        self.sizes = np.fromiter(map(len, table), dtype=np.int64, count=len(table))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.buffer = np.frombuffer(b"".join(table), dtype=np.uint8)

    def spell(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.starts[ids] - ends + sizes, sizes)
        return self.buffer[shift + np.arange(len(shift))].tobytes()


@lru_cache(maxsize=4)
def loaded(path: str) -> tuple[Merges, Transducer, ByteTable]:
    """Once in a worker: merges, the transducer with its memo and the bytes of each id."""
    merges = Merges.load(path)
    return merges, Transducer(merges), ByteTable(merges)


def decode_pieces(ids: np.ndarray, table: ByteTable, piece: int = 1 << 14) -> Iterator[str]:
    """The text that ids stand for, piece by piece."""
    machine = TextMachine()
    for k in range(0, len(ids), piece):
        yield machine.feed(table.spell(ids[k : k + piece]))
    yield machine.finish()


class RoundTrip:
    """Count and digests of a text's ids and of what they decode to, as the ids come."""

    def __init__(self, table: ByteTable, keep: bool):
        self.table, self.machine = table, TextMachine()
        self.n, self.ids_digest, self.text_digest = 0, hashlib.sha256(), hashlib.sha256()
        self.kept: tuple[list[int], list[str]] | None = ([], []) if keep else None

    def feed(self, ids: np.ndarray, piece: int = 1 << 14) -> None:
        self.n += len(ids)
        self.ids_digest.update(ids.tobytes())
        for k in range(0, len(ids), piece):
            self._text(self.machine.feed(self.table.spell(ids[k : k + piece])))
        if self.kept:
            self.kept[0].extend(ids.tolist())

    def _text(self, text: str) -> None:
        self.text_digest.update(text.encode("utf-8", "surrogatepass"))
        if self.kept:
            self.kept[1].append(text)

    def finish(self) -> list:
        self._text(self.machine.finish())
        row = [self.n, self.ids_digest.hexdigest(), self.text_digest.hexdigest()]
        return row + [self.kept[0], "".join(self.kept[1])] if self.kept else row


def encode_decode(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids again, give counts and digests.

    Null texts count as empty (no tokens, digests of nothing); repeated rows give
    repeated results; other columns of ``docs`` are not carried. ``with_ids`` adds
    ``ids`` and ``decoded``. ``vocabulary`` is a path that executors can read.
    Ids are digested and decoded as they become stable, so without ``with_ids`` a
    long text takes no more memory than a chunk of it. Narrow: one pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, transducer, table = loaded(vocabulary)
        for batch in batches:
            out: list[list] = [[] for _ in names[1:]]
            trip = None
            for _, _, ids, end in transducer.rows(batch, 1):
                trip = trip or RoundTrip(table, with_ids)
                trip.feed(ids)
                if end:
                    for column, value in zip(out, trip.finish()):
                        column.append(value)
                    trip = None
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=t) for c, t in zip(out, types))], names)

    names, types = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        names, types, schema = [*names, "ids", "decoded"], [*types, pa.list_(pa.int32()), pa.string()], schema + ", ids array<int>, decoded string"
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, schema)
