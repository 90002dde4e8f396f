"""Byte-level BPE by speculation: greedy longest matches are checked pair by pair, only failures are merged exactly.

A token sequence is the BPE encoding of its bytes if every token is the encoding of its own bytes and no
merge could have crossed the boundary of any two neighbours. New words get greedy tokens first; all their
neighbouring pairs are tested together in numpy; the words with a failing token or pair are merged exactly.
The vocabulary file's path is a parameter; the file must be readable on every worker.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import slices, text_array

SLICE = 1 << 20  # bytes of text, or number of ids, that are worked on at once
CACHED_WORDS = 250_000  # words whose tokens a worker remembers
PAIR_BITS = 32
SHORT = 48  # bytes of words that are merged side by side; longer ones one by one with a heap
# Fixed value: the word pattern of byte-level vocabularies, letters first (no alternative starts like another).
WORDS = r" ?\p{L}++|'(?:s|t|re|ve|m|ll|d)| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
UNASSIGNED = "͸"  # of no class in any Unicode version


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of every byte: itself if printable Latin-1, else the next from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE file: merges as arrays, added tokens, and the tokens of words met so far."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
        if model["type"] != "BPE" or not plain or pre["add_prefix_space"] or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take in their surroundings")
        symbols = byte_symbols()
        ids = {bytes(symbols[c] for c in token): i for token, i in model["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.added.values()]) + 1
        pieces = [b""] * size
        for piece, i in ids.items():
            pieces[i] = piece
        for content, i in self.added.items():
            pieces[i] = content.encode()
        self.pieces = pa.array(pieces, pa.large_binary())
        self.ids = ids
        self._set_merges(model, symbols, size)
        self.byte_token = np.array([ids[bytes([b])] for b in range(256)], dtype=np.int64)
        self._set_trie()
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words = regex.compile(WORDS)
        self.newer = self._newer_letters(path)
        self.known: dict[str, bytes] = {}

    def _set_merges(self, model: dict, symbols: dict, size: int) -> None:
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab = model["vocab"]
        left, right, made = (np.array(x, dtype=np.int64) for x in zip(*[(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], strict=True))
        self.rank = np.full(size, -1, dtype=np.int64)  # the merge that makes a token; -1 for single bytes
        self.left, self.right = np.arange(size), np.arange(size)
        self.rank[made[::-1]] = np.arange(len(made))[::-1]
        self.left[made[::-1]], self.right[made[::-1]] = left[::-1], right[::-1]
        keys = left << PAIR_BITS | right
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks, self.pair_made = keys[order], order, made[order]
        self.merge = dict(zip(keys.tolist(), zip(range(len(made)), made.tolist(), strict=True), strict=True))
        # A merged token is the encoding of its own bytes if its halves are and nothing crosses them earlier.
        merged = np.flatnonzero(self.rank >= 0)
        own = np.ones(size, dtype=bool)
        own[merged] = self.compatible(self.left[merged], self.right[merged], self.rank[merged])
        for token in merged[np.argsort(self.rank[merged])]:
            own[token] &= own[self.left[token]] and own[self.right[token]]
        own[made[self.rank[made] != np.arange(len(made))]] = False  # made by several merges: leave to exact merging
        self.own = own

    def _newer_letters(self, path: str):
        """Characters that the pattern library takes for letters or numbers and the tokenizer library, of an older Unicode, does not."""
        from tokenizers import Tokenizer

        late = "".join(c for c in map(chr, range(0x370, 0x110000)) if unicodedata.category(c) == "Cn")
        doubtful = regex.findall(r"[\p{L}\p{N}\s]", late)
        if not doubtful:
            return None
        pre = Tokenizer.from_file(path).pre_tokenizer
        probe = "".join(f"a{c}1\n" for c in doubtful)  # cut off from both its neighbours if it is of neither's class
        cuts = {start for _, (start, _) in pre.pre_tokenize_str(probe)}
        newer = sorted(ord(c) for i, c in enumerate(doubtful) if 4 * i + 1 in cuts and 4 * i + 2 in cuts)
        runs: list[list[int]] = []
        for code in newer:
            if runs and runs[-1][1] == code - 1:
                runs[-1][1] = code
            else:
                runs.append([code, code])
        return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs) + "]") if runs else None

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge of a rank below ``limit`` crosses the boundary of tokens a, b, for all pairs at once.

        Walks back in time: the later-made of the two tokens at the boundary is undone, and a merge of what
        then meets there would have come first if its rank is below that of the undone one (or equal to it
        on the right side, as merges of one rank run from the left).
        """
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max) if limit is None else limit.copy()
        good, active = np.ones(len(a), dtype=bool), np.arange(len(a))
        while len(active):
            x, y = a[active], b[active]
            keys = x << PAIR_BITS | y
            at = np.minimum(self.pair_keys.searchsorted(keys), len(self.pair_keys) - 1)
            crossed = (self.pair_keys[at] == keys) & (self.pair_ranks[at] < limit[active])
            good[active[crossed]] = False
            undo_left = self.rank[x] > self.rank[y]
            going = ~crossed & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            one, two = active[going & undo_left], active[going & ~undo_left]
            limit[one], limit[two] = self.rank[a[one]], self.rank[b[two]] + 1
            a[one], b[two] = self.right[a[one]], self.left[b[two]]
            active = active[going]
        return good

    def _set_trie(self) -> None:
        """Every prefix of a token is a node; edges are sorted by (node, byte). Nodes 0-255 are the bytes."""
        nodes = {bytes([b]): b for b in range(256)}
        keys = []
        for piece in self.ids:
            for end in range(2, len(piece) + 1):
                prefix = piece[:end]
                if prefix not in nodes:
                    nodes[prefix] = len(nodes)
                    keys.append(nodes[piece[: end - 1]] << 8 | piece[end - 1])
        self.edges, order = np.unique(np.array([*keys, np.iinfo(np.int64).max], dtype=np.int64), return_index=True)
        self.edge_to = order + 256  # nodes were numbered as their edges were made
        self.node_token = np.full(len(nodes) + 1, -1, dtype=np.int64)
        for piece, token in self.ids.items():
            self.node_token[nodes[piece]] = token

    def greedy(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches from the left of all words side by side: tokens and how many each word has."""
        data = np.frombuffer(b"".join(words) + b"\0", dtype=np.uint8)
        ends = np.cumsum([len(w) for w in words])
        at = ends - [len(w) for w in words]  # the next byte
        word = np.flatnonzero(at < ends)
        at, ends = at[word], ends[word]
        node = data[at].astype(np.int64)
        at = at + 1
        token, stop = self.node_token[node], at.copy()
        owners, found = [], []
        while len(word):
            key = node << 8 | data[at]
            edge = self.edges.searchsorted(key)
            going = (at < ends) & (self.edges[edge] == key)
            node = np.where(going, self.edge_to[edge], node)
            at = at + going
            better = going & (self.node_token[node] >= 0)
            token, stop = np.where(better, self.node_token[node], token), np.where(better, at, stop)
            done = ~going
            owners.append(word[done])
            found.append(token[done])
            # Whoever is done starts anew behind its longest match, or leaves.
            start = data[np.minimum(stop, len(data) - 1)].astype(np.int64)
            staying = ~done | (stop < ends)
            node = np.where(done, start, node)
            at = np.where(done, stop + 1, at)
            token, stop = np.where(done, self.node_token[start], token), np.where(done, stop + 1, stop)
            word, node, at, ends, token, stop = (x[staying] for x in (word, node, at, ends, token, stop))
        owner = np.concatenate(owners) if owners else np.empty(0, np.int64)
        order = np.argsort(owner, kind="stable")
        tokens = np.concatenate(found)[order] if found else np.empty(0, np.int64)
        return tokens, np.bincount(owner, minlength=len(words))

    def merge_all(self, words: list[bytes]) -> list[np.ndarray]:
        """Exact merging of many short words side by side: each round merges every word's leftmost best pair."""
        token = self.byte_token[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        out: list = [None] * len(words)
        never = np.iinfo(np.int64).max
        while len(token):
            keys = token << PAIR_BITS | np.append(token[1:], 0)
            at = np.minimum(self.pair_keys.searchsorted(keys), len(self.pair_keys) - 1)
            inside = np.append(owner[1:] == owner[:-1], False)
            rank = np.where(inside & (self.pair_keys[at] == keys), self.pair_ranks[at], never)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(token)))
            ended = np.repeat(best == never, sizes)
            for start, size in zip(starts[best == never], sizes[best == never], strict=True):
                out[owner[start]] = token[start : start + size]
            hit = np.flatnonzero((rank == np.repeat(best, sizes)) & ~ended)
            hit = hit[np.append(True, owner[hit][1:] != owner[hit][:-1])] if len(hit) else hit
            token[hit] = self.pair_made[at[hit]]
            ended[hit + 1] = True
            token, owner = token[~ended], owner[~ended]
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merge by rank, leftmost first, with a heap of candidate pairs over a linked list."""
        token = [self.ids[word[i : i + 1]] for i in range(len(word))]
        after, before = list(range(1, len(token) + 1)), list(range(-1, len(token) - 1))
        merge, heap = self.merge, []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(token):
                found = merge.get(token[i] << PAIR_BITS | token[after[i]])
                if found:
                    heapq.heappush(heap, (found[0], i, token[i], token[after[i]], found[1]))

        for i in range(len(token)):
            offer(i)
        while heap:
            _, i, x, y, made = heapq.heappop(heap)
            j = after[i]
            if token[i] != x or j >= len(token) or token[j] != y:
                continue
            token[i], token[j] = made, -1
            after[i] = after[j]
            if after[i] < len(token):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [t for t in token if t >= 0]

    def learn(self, words: list[str]) -> None:
        """Tokens of new words: greedy, all pairs checked at once, exact where a check fails."""
        raw = [w.encode() for w in words]
        flat, counts = self.greedy(raw)
        owner = np.repeat(np.arange(len(words)), counts)
        failed = np.zeros(len(words), dtype=bool)
        failed[owner[~self.own[flat]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        failed[owner[inner[~self.compatible(flat[inner], flat[inner + 1])]]] = True
        data, ends = flat.astype(np.int32).tobytes(), 4 * np.cumsum(counts)
        self.known.update((w, data[e - 4 * n : e]) for w, e, n in zip(words, ends.tolist(), counts.tolist(), strict=True))
        again = np.flatnonzero(failed)
        short = [i for i in again if len(raw[i]) <= SHORT]
        merged = zip(short, self.merge_all([raw[i] for i in short]), strict=True)
        one_by_one = ((i, np.array(self.exact(raw[i]))) for i in again if len(raw[i]) > SHORT)
        self.known.update((words[i], tokens.astype(np.int32).tobytes()) for i, tokens in chain(merged, one_by_one))

    def cut(self, text: str) -> list[str]:
        """The words of a text; added tokens stand alone and end the words beside them."""
        if self.split_added is not None and any(t in text for t in self.added):
            parts = self.split_added.split(text)
            return list(chain.from_iterable([p] if i % 2 else self._plain(p) for i, p in enumerate(parts)))
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")  # the quickest test: no newer letters there
            plain = True
        except UnicodeEncodeError:
            plain = self.newer is None or not self.newer.search(text)
        if plain:
            return self.words.findall(text)
        stand_in = self.newer.sub(UNASSIGNED, text)
        return [text[m.start() : m.end()] for m in self.words.finditer(stand_in)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.cut(t) for t in texts]
        found = [list(map(self.known.get, words)) for words in cut]
        missing = {w for words, got in zip(cut, found, strict=True) if None in got for w, g in zip(words, got, strict=True) if g is None}
        if missing:
            if len(self.known) > CACHED_WORDS:
                self.known.clear()
            self.known.update((c, np.array([i], dtype=np.int32).tobytes()) for c, i in self.added.items())
            if new := [w for w in missing if w not in self.known]:
                self.learn(new)
            if not all(None not in got for got in found):
                # What was found before a clearing is kept; only the gaps are filled.
                found = [[g if g is not None else self.known[w] for w, g in zip(words, got, strict=True)] for words, got in zip(cut, found, strict=True)]
        return [np.frombuffer(b"".join(got), dtype=np.int32) for got in found]

    def decode(self, ids: pa.Array) -> pa.Array:
        """Texts of lists of ids; bytes that are no UTF-8 become replacement characters."""
        flat = ids.flatten()
        taken = self.pieces.take(flat)
        ends = np.concatenate(([0], np.cumsum(_lengths(taken))))
        offsets = ends[ids.offsets.to_numpy() - ids.offsets[0].as_py()]
        data = taken.buffers()[2] if len(taken) else None
        data = data if data is not None else pa.py_buffer(b"")
        texts = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(offsets.astype(np.int64)), data)
        try:
            texts.validate(full=True)
            return texts
        except pa.ArrowInvalid:
            return pa.array([t.decode("utf-8", "replace") for t in texts.cast(pa.large_binary()).to_pylist()], pa.large_string())


def _lengths(binary: pa.Array) -> np.ndarray:
    return np.diff(np.frombuffer(binary.buffers()[1], dtype=np.int64)[binary.offset : binary.offset + len(binary) + 1])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Read once in each worker."""
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every row's whole text, without added special tokens.

    Strings of the file's added tokens inside a text are those tokens. Null and empty texts have no ids. Rows
    with equal or null ids are kept as they are; other columns are not looked at.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for part in slices(batches, limit=SLICE):
            found = vocab.encode(text_array(part.column("text")).to_pylist())
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (``doc_id``, ``ids``) with its ``text``, special tokens included; null ids give empty text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy())
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(ends.searchsorted((ends[start - 1] if start else 0) + SLICE, side="right")))
                part = batch.slice(start, stop - start)
                ids = part.column("ids").take(pa.array(np.arange(len(part))))
                if ids.null_count:
                    ids = pa.array([x or [] for x in ids.to_pylist()], ids.type)
                yield pa.RecordBatch.from_arrays([*part.columns, vocab.decode(ids).cast(pa.string())], ["doc_id", "ids", "text"])
                start = stop

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digests of encoding and decoding: ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``."""
    return decode(encode(docs, path), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
