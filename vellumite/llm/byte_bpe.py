"""Operator 7: byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1 characters, so that one pyahocorasick trie over the vocabulary finds the longest token
that starts at a byte. The encoder takes longest matches from the left and backtracks to
shorter prefixes where two adjacent tokens are not what the merges would have left next to each other. Whether a pair is
compatible is found by undoing its merges step by step, and memoised; a place that led nowhere is never tried again, so
the work is linear in the piece. The ids are exactly those of applying the merges by rank.

Short pieces that are not remembered are encoded together, those of a block of texts at once, by the merges themselves:
pieces of as many tokens are the rows of a matrix, each step makes in every row the merge of least rank that is
furthest left, and rows go on into the matrix of one token less until no merge is left. What a block says again and
again is looked up once; the ids of its texts are then gathered as arrays.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator
from functools import cached_property
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumite.llm._shared import column

#: Entries that a memory holds in each of its two generations, and pairs of adjacent tokens, per worker.
MEMO, MEMO_OF_RUNS = 1 << 15, 1 << 17
PAIRS = 1 << 18
#: Longer pieces are encoded each time.
MEMO_PIECE = 64
#: Matches of the pattern that are taken at once from a text.
AT_ONCE = 1 << 18
#: Characters at which a block of texts takes no further text, and pieces that are encoded at once.
BLOCK, TOGETHER = 1 << 22, 1 << 15
#: The rank of two tokens that no merge joins.
NEVER = np.iinfo(np.int32).max


def read_ranks(path: str) -> dict[bytes, int]:
    """A .tiktoken file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def ways(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Every way to make a token of two: first * (highest rank + 2) + second, in order, and the token."""
    top = max(ranks.values(), default=0) + 2
    made = sorted((first * top + second, rank) for token, rank in ranks.items() for n in range(1, len(token)) if (first := ranks.get(token[:n])) is not None and (second := ranks.get(token[n:])) is not None)
    return np.array([pair for pair, _ in made] or [-1], np.int64), np.array([rank for _, rank in made] or [NEVER], np.int32)


class Codec:
    """Encodes and decodes by ranks; pattern cuts a text into pieces that no token crosses.

    space_leads: the pattern takes a space between two other non-space characters only as the first character of a
    piece, takes letters behind such a space as one piece, and looks behind at nothing. Texts are then cut at such spaces first, and what stands between is remembered
    as a whole, which spares most of the matching."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, space_leads: bool = False, made: tuple[np.ndarray, np.ndarray] | None = None):
        self.ranks, self.pattern, self.space_leads, self.made = ranks, pattern, space_leads, made or ways(ranks)
        self._ready()

    def __getstate__(self):
        return self.ranks, self.pattern, self.space_leads, self.made

    def __setstate__(self, state):
        self.ranks, self.pattern, self.space_leads, self.made = state
        self._ready()

    def _ready(self) -> None:
        self.cut = regex.compile(self.pattern)
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.top = max(self.bytes_of, default=0) + 2
        self.most = max(map(len, self.ranks), default=0)
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.longest_of: dict[str, int | None] = {}
        self.alone = {token: np.int32(rank).tobytes() for token, rank in self.ranks.items()}
        ordered = [self.bytes_of.get(rank) for rank in range(self.top - 1)]
        self.tokens = pa.array(ordered, pa.large_binary())
        self.decimals = pa.array([b"%d " % rank for rank in range(self.top - 1)], pa.large_binary())
        self.piece, self.led = _Memo(MEMO), _Memo(MEMO_OF_RUNS)
        self.of_byte = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.together = bool((self.of_byte >= 0).all())
        self.pairs, self.merged = self.made

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        trie = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            trie.add_word(token.decode("latin-1"), rank)
        if self.ranks:
            trie.make_automaton()
        return trie

    @cached_property
    def by_text(self) -> dict[str, int]:
        return {token.decode("latin-1"): rank for token, rank in self.ranks.items()}

    @cached_property
    def length(self) -> dict[int, int]:
        return {rank: len(token) for token, rank in self.ranks.items()}

    @cached_property
    def shorter(self) -> dict[int, int | None]:
        return {rank: self._prefix(token) for token, rank in self.ranks.items()}

    def forget(self) -> None:
        """Let go of all that is remembered, and of the tables: the codec is of no more use."""
        self.__dict__.clear()

    def _half(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a byte or a token that no merge makes."""
        if token not in self.halves:
            parts = [bytes([b]) for b in self.bytes_of[token]]
            while len(parts) > 2:
                best = min((self.ranks.get(parts[i] + parts[i + 1], token), i) for i in range(len(parts) - 1))
                if best[0] >= token:
                    break
                i = best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def _prefix(self, token: bytes) -> int | None:
        """The longest token that is a proper prefix of this one."""
        return next((self.ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), None)

    def _fit(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens side by side."""
        # Undo the later of the two merges next to the border, again and again. A merge across the border that comes
        # before the one just undone would have been made instead, and the pair could not have come about.
        bound, ranks, text, halves = self.top, self.ranks, self.bytes_of, self.halves
        while True:
            across = ranks.get(text[left] + text[right])
            if across is not None and across < bound:
                return False
            parts_left = halves[left] if left in halves else self._half(left)
            parts_right = halves[right] if right in halves else self._half(right)
            # of merges of equal rank the one further left is made first, thus a tie goes to the right side
            if parts_left is not None and (parts_right is None or left > right):
                bound, left = left, parts_left[1]
            elif parts_right is not None:
                bound, right = right + 1, parts_right[0]
            else:
                return True

    def _longest(self, text: str, at: int) -> int | None:
        """The longest token at a place of a text, remembered by what stands there."""
        rest = text[at : at + self.most]
        token = self.longest_of.get(rest, -1)
        if token == -1:
            token = next((t for end in range(self.automaton.longest_prefix(rest), 0, -1) if (t := self.by_text.get(rest[:end])) is not None), None)
            if len(rest) <= MEMO_PIECE:
                if len(self.longest_of) >= MEMO:
                    self.longest_of.clear()
                self.longest_of[rest] = token
        return token

    def _fits(self, pair: tuple[int, int]) -> bool:
        ok = self.fits.get(pair)
        if ok is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            ok = self.fits[pair] = self._fit(*pair)
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        text = piece.decode("latin-1")
        n, length, shorter, known = len(text), self.length, self.shorter, self.fits.get
        # longest matches from the left, in one pass; tokens that are compatible, each with the next, are the merges' own
        out = [token for _, token in self.automaton.iter_long(text)]
        if sum([length[t] for t in out]) != n:  # bytes that no token has are passed over
            out, token, at = [], self._longest(text, 0), 0
        elif all(map(known, zip(out, out[1:]))):  # noqa: B905
            return out
        else:
            good = next((k for k, pair in enumerate(zip(out, out[1:]), 1) if not self._fits(pair)), len(out))  # noqa: B905
            if good == len(out):
                return out
            token = shorter[out[good]]
            del out[good:]
            at = sum([length[t] for t in out])
        # from there on back to shorter prefixes, and on with longest matches
        fits, longest, dead = self._fits, self._longest, set()
        while at < n:
            if token is None:  # no token leads on from here: back to a shorter one before, and never here again
                if not out:
                    raise ValueError("the vocabulary cannot spell this piece")
                dead.add(at)
                last = out.pop()
                at -= length[last]
                token = shorter[last]
                continue
            end = at + length[token]
            if end not in dead and (not out or known(pair := (out[-1], token)) or fits(pair)):
                out.append(token)
                at = end
                token = longest(text, at) if at < n else None
            else:
                token = shorter[token]
        return out

    def _merge(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Of tokens side by side the token that a merge makes of them, which is its rank."""
        pair = first.astype(np.int64) * self.top + second
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.merged[at], NEVER)

    def encode_together(self, pieces: list[bytes]) -> list[bytes]:
        """What encode_piece gives for each of these, of which none is empty, as 32-bit numbers. The vocabulary has every byte."""
        out = [b""] * len(pieces)
        size = np.array([len(p) for p in pieces])
        order = np.argsort(size, kind="stable")
        most = int(size.max(initial=0))
        cut = np.searchsorted(size[order], np.arange(most + 2))
        tokens = self.of_byte[np.frombuffer(b"".join([pieces[i] for i in order.tolist()]), np.uint8)]
        ends = np.append(0, np.cumsum(size[order]))
        ids, of = np.empty((0, most), np.int32), order[:0]
        ranks = np.empty((0, max(0, most - 1)), np.int32)
        for n in range(most, 0, -1):
            lo, hi = cut[n], cut[n + 1]
            if lo < hi:  # pieces of n bytes come in
                new = tokens[ends[lo] : ends[hi]].reshape(-1, n)
                ids, of = np.concatenate([ids, new]), np.append(of, order[lo:hi])
                ranks = np.concatenate([ranks, self._merge(new[:, :-1], new[:, 1:])])
            row = np.arange(len(ids))
            best = ranks.argmin(1) if n > 1 else np.zeros(len(ids), np.int64)
            token = ranks[row, best] if n > 1 else np.full(len(ids), NEVER)
            go = token != NEVER
            found = ids[~go].tobytes()
            for i, at in zip(of[~go].tolist(), range(0, len(found), 4 * n), strict=True):
                out[i] = found[at : at + 4 * n]
            if n == 1:
                break
            ids, ranks, of, best, token = ids[go], ranks[go], of[go], best[go], token[go]
            row = np.arange(len(ids))
            keep = np.ones(ids.shape, bool)
            keep[row, best + 1] = False
            ids[row, best] = token
            ids = ids[keep].reshape(len(ids), n - 1)
            keep = np.ones(ranks.shape, bool)
            keep[row, best] = False
            ranks = ranks[keep].reshape(len(ids), n - 2)
            left, right = best > 0, best < n - 2
            ranks[row[left], best[left] - 1] = self._merge(ids[row[left], best[left] - 1], token[left])
            ranks[row[right], best[right]] = self._merge(token[right], ids[row[right], best[right] + 1])
        return out

    def _encoded(self, pieces: list[str]) -> Iterator[bytes]:
        """The ids of pieces, as 32-bit numbers."""
        for at in range(0, len(pieces), TOGETHER):
            raw = [p.encode() for p in pieces[at : at + TOGETHER]]
            ids = [self.alone.get(r) for r in raw]
            some = [i for i, x in enumerate(ids) if x is None and len(raw[i]) <= MEMO_PIECE and self.together]
            for i, x in zip(some, self.encode_together([raw[i] for i in some]), strict=True):
                ids[i] = x
            yield from [np.array(self.encode_piece(r), np.int32).tobytes() if x is None else x for r, x in zip(raw, ids, strict=True)]

    def _of_pieces(self, pieces: set[str]) -> dict[str, bytes]:
        known = {p: self.piece.find(p) for p in pieces}
        lacking = [p for p, ids in known.items() if ids is None]
        for p, ids in zip(lacking, self._encoded(lacking), strict=True):
            known[p] = ids
            self.piece.keep(p, ids)
        return known

    def _of_runs(self, rests: list[str], counts: list[int], pieces: set[str]) -> tuple[list[bytes], dict[str, bytes]]:
        """The ids of what stands behind a space, up to the next one, with that space; and those of pieces."""
        out = [self.led.find(x) if n else b"" for x, n in zip(rests, counts, strict=True)]
        lacking = [i for i, ids in enumerate(out) if ids is None]
        alike = [i for i in lacking if rests[i].isalpha()]
        for i, ids in zip(alike, self._encoded([" " + rests[i] for i in alike]), strict=True):
            out[i] = ids
        mixed = [(i, self.cut.findall(" " + rests[i])) for i in lacking if out[i] is None]
        known = self._of_pieces(pieces.union(*[own for _, own in mixed]))
        for i, own in mixed:
            out[i] = b"".join([known[p] for p in own])
        for i in lacking:
            if counts[i] > 1:
                self.led.keep(rests[i], out[i])
        return out, known

    def block(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each of these texts, which are short."""
        if not texts:
            return iter(())
        led = [self.space_leads and not _odd_space(text) for text in texts]
        by_spaces = np.array(led, bool)
        lists = pc.split_pattern(pa.array([text for text, x in zip(texts, led, strict=True) if x], pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        rests, unit = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        start = lists.offsets.to_numpy()
        # what a text begins with has no space before it
        cut = iter([self.cut.findall(rests[unit[i]]) for i in start[:-1]])
        cuts = [next(cut) if x else self.cut.findall(text) for text, x in zip(texts, led, strict=True)]
        counts = np.bincount(unit, minlength=len(rests)) - np.bincount(unit[start[:-1]], minlength=len(rests))
        units, known = self._of_runs(rests, counts.tolist(), set(chain.from_iterable(cuts)))
        # a first unit for each text, then what is led by spaces
        first = len(units) + np.arange(len(texts))
        units += [b"".join([known[p] for p in own]) for own in cuts]
        unit[start[:-1]] = first[by_spaces]
        n = np.ones(len(texts), np.int64)
        n[by_spaces] = np.diff(start)
        of = np.repeat(by_spaces, n)
        every = np.empty(len(of), np.int64)
        every[of], every[~of] = unit, first[~by_spaces]
        size = np.array([len(x) for x in units], np.int64) // 4
        own, base = size[every], np.cumsum(size) - size
        ends = np.append(0, np.cumsum(own))
        ids = np.frombuffer(b"".join(units), np.int32)[np.repeat(base[every] - ends[:-1], own) + np.arange(ends[-1])]
        at = ends[np.append(0, np.cumsum(n))].tolist()
        return (ids[a:b] for a, b in zip(at, at[1:], strict=False))

    def ids(self, texts: list[str]) -> Iterator[Iterator[np.ndarray]]:
        """The ids of each text, in parts of bounded length."""
        at = 0
        while at < len(texts):
            lo, size = at, 0
            while at < len(texts) and size < BLOCK:
                size += len(texts[at])
                at += 1
            short = self.block([text for text in texts[lo:at] if len(text) <= AT_ONCE])
            for text in texts[lo:at]:
                yield iter([next(short)]) if len(text) <= AT_ONCE else self._long(text)

    def _long(self, text: str) -> Iterator[np.ndarray]:
        found = self.cut.finditer(text)
        while some := [m[0] for m in islice(found, AT_ONCE)]:
            known = self._of_pieces(set(some))
            yield np.frombuffer(b"".join([known[p] for p in some]), np.int32)

    def encode(self, text: str) -> list[int]:
        return [i for parts in self.ids([text]) for part in parts for i in part.tolist()]

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        return _joined(self.tokens, ids)

    def told(self, ids: list[int] | np.ndarray) -> bytes:
        """Ids in decimal, with a space between two."""
        return _joined(self.decimals, ids)[:-1]


def _joined(values: pa.LargeBinaryArray, at: list[int] | np.ndarray) -> bytes:
    found = values.take(pa.array(at, pa.int32()))
    _, ends, data = found.buffers()
    return data.to_pybytes()[: np.frombuffer(ends, np.int64)[len(found)]] if len(found) and data else b""


#: All that \\s matches, but for the space.
BLANKS = [chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def _odd_space(text: str) -> bool:
    """Whether a space is next to another white space."""
    return "  " in text or any(c in text and (c + " " in text or " " + c in text) for c in BLANKS)


class _Memo(dict):
    """What is remembered of short keys: a full generation becomes the old one, of which what is found again stays."""

    def __init__(self, most: int):
        self.most, self.old = most, {}

    def find(self, key: str):
        value = self.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.keep(key, value)
        return value

    def keep(self, key: str, value) -> None:
        if len(key) <= MEMO_PIECE:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, space_leads: bool = False, keep_ids: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Encode each whole text and decode its ids again: one row for every row of docs, in its partition, without a shuffle.

    A null or empty text has no tokens (both digests are those of the empty string). Repeated rows give repeated rows; a
    null doc_id stays null; ties don't arise; an empty table gives no rows; other columns are not read. keep_ids adds
    token_ids array<int>; carry names columns of docs to keep. Memory: one batch of texts, the pieces and ids of one
    block of texts, and memories of bounded numbers of entries. Decoding works from the ids alone."""
    if clash := {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip", "token_ids"} & set(carry):
        raise ValueError(f"columns of the result cannot be carried: {sorted(clash)}")
    codec = docs.sparkSession.sparkContext.broadcast((ranks, pattern, space_leads, ways(ranks)))
    texts = docs.select("doc_id", *carry, F.col("text").cast("string").alias("text"))
    kept = texts.drop("doc_id", "text").schema
    schema = SCHEMA + (", token_ids array<int>" if keep_ids else "") + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kept)

    def encoded(batches):
        own = Codec(*codec.value)
        gc.disable()  # what is remembered has no cycles, and is much to look through
        try:
            yield from coded(own, batches)
        finally:
            own.forget()  # the worker may have other work next
            gc.enable()
            gc.collect()

    def coded(own, batches):
        space = b" "
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows: list[tuple] = []
                ids_out: list[np.ndarray | list] = []
                texts = [text or "" for text in column(part, "text").to_pylist()]
                for text, parts in zip(texts, own.ids(texts), strict=True):
                    raw = text.encode()
                    ids_sum, text_sum, n, size, same, all_ids = hashlib.sha256(), hashlib.sha256(), 0, 0, True, []
                    for ids in parts:
                        if n:
                            ids_sum.update(space)
                        ids_sum.update(own.told(ids))
                        n += len(ids)
                        back = own.decode(ids)
                        text_sum.update(back)
                        same = same and raw.startswith(back, size)
                        size += len(back)
                        if keep_ids:
                            all_ids.append(ids)
                    ids_out.append(np.concatenate(all_ids) if all_ids else [])
                    rows.append((n, ids_sum.hexdigest(), text_sum.hexdigest(), same and size == len(raw)))
                cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
                arrays = [column(part, "doc_id").cast(pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.bool_())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
                if keep_ids:
                    arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays([*arrays, *(column(part, c) for c in carry)], [*names, *carry])

    return texts.mapInArrow(encoded, schema)
