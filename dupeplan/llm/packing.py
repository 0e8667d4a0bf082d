"""Packing of tokenized documents into windows of several context sizes.

A document's whole longest windows are cut off first. What remains of it is
routed to the smallest tier that holds it. Windows are then opened from the
longest remainder down; each gap is filled with the longest remainder of a
shorter tier that fits, or else with a part cut from one, until the window is
full. Only when a chunk of documents runs out of tokens is a window left part
full; it is divided into windows of powers of two, so that nothing is padded.
Windows are dealt to step groups, the longest first, each to the group with the
fewest tokens so far.

Chunks of documents are packed where they are read: no shuffle, and a lost task
is simply run again. Sequences, step groups and what is left over at the end are
those of a chunk of 8 MB. Null and empty texts are documents of the end token alone.
Repeated rows and null keys are packed like any others. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from dupeplan.llm.common import LOWERED, bound_batches, buffers, chunks, worker_state, words_in

TIERS = (256, 512, 1024, 2048)
END = 1
#: Tokens of a step group.
STEP = 16 * 2048
#: Words whose tokens a Python worker remembers.
REMEMBERED = 400_000


#: How a tokenizer treats a text before its model sees it, if the ids of a text are those of its lower-cased words in a row.
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class WordTokens:
    """Token ids of words, each word tokenized once while it is remembered.

    A tokenizer that is known not to join what white space parts gives a text
    the ids of its words in a row (``by_word``); any other one is given whole
    texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        self.by_word = all(made[k] == v for k, v in BY_WORD.items()) and all(t["content"].startswith("<|") for t in made["added_tokens"])
        self.known: dict[str, list[int]] = {}

    def whole(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each text's followed by the end id; where each text's ids begin)."""
        parts = [np.zeros(0, np.uint32)]
        for text in column.to_pylist():
            found = self.tokenizer.encode_batch_fast([text or ""], add_special_tokens=False)[0].ids
            parts.append(np.array([*found, END], np.uint32))
        return np.concatenate(parts), np.cumsum([len(x) for x in parts])

    def flat(self, words: list[str], again: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each); words that stand ``again`` in the texts are remembered."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        found = [known.get(w) for w in words]
        new = [i for i, ids in enumerate(found) if ids is None]
        for i in range(0, len(new), 10_000):
            part = new[i : i + 10_000]
            for j, e in zip(part, self.tokenizer.encode_batch_fast([words[j] for j in part], add_special_tokens=False), strict=True):
                found[j] = e.ids
                if again[j]:
                    known[words[j]] = found[j]
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))


_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_MARK = np.array([chr(b) in '.,;:!?()"' for b in range(256)])


def parted(column: pa.Array) -> tuple[np.ndarray, bytes]:
    """(offsets, bytes) of the texts with a space between letters and marks that meet, lower-cased if no special token can be there.

    The tokenizer lower-cases and parts letters from such marks itself, so its
    ids stay the same; words recur far more often without their marks. Letters
    here are those of ASCII and U+00C0 to U+00FF.
    """
    offsets, data = buffers(column)
    if len(data) < 2:
        return offsets, data.tobytes()
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    ends = _LETTER[data] | latin
    begins = _LETTER[data[1:]] | ((data[1:] == 0xC3) & ~np.append((data[2:] == 0x97) | (data[2:] == 0xB7), True))
    mark = _MARK[data]
    at = np.flatnonzero((ends[:-1] & mark[1:]) | (mark[:-1] & begins)) + 1
    out = np.full(len(data) + len(at), 32, np.uint8)
    place = np.arange(len(data))
    place += np.cumsum(np.bincount(at, minlength=len(data))[: len(data)])
    out[place] = data
    raw = out.tobytes()
    if b"<|" not in raw:
        raw = raw.translate(LOWERED)
    return offsets + np.searchsorted(at, offsets, "left"), raw


def tokenize(column: pa.Array, tokens: WordTokens) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, each text's followed by the end id; where each text's ids begin)."""
    if not tokens.by_word:
        return tokens.whole(column)
    words, ids, at = words_in(*parted(column))
    flat, counts = tokens.flat(words.to_pylist(), (np.bincount(ids, minlength=len(words)) > 1).tolist())
    starts = np.concatenate([[0], np.cumsum(counts)])
    flat, counts = np.append(flat, np.uint32(END)), np.append(counts, 1)
    ids = np.insert(ids, at[1:], len(words))
    own = counts[ids]
    ends = np.cumsum(own)
    out = flat[np.repeat(starts[ids] - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)]
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], at[1:] + np.arange(1, len(at))])]
    return out, bounds


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (document, start, length); all tokens lie in exactly one."""
    longest = tiers[-1]
    windows: list[list[tuple[int, int, int]]] = []
    pool: list[list[tuple[int, int]]] = [[] for _ in range(longest + 1)]  # by length: (document, start)
    there = 0  # bit n: the pool holds a piece of length n
    for doc, n in enumerate(lengths):
        start = 0
        while n - start >= longest:
            windows.append([(doc, start, longest)])
            start += longest
        if n > start:
            pool[n - start].append((doc, start))
            there |= 1 << (n - start)

    def take(most: int) -> tuple[int, int, int] | None:
        nonlocal there
        n = (there & ((2 << most) - 1)).bit_length() - 1
        if n <= 0:
            return None
        doc, start = pool[n].pop()
        if not pool[n]:
            there ^= 1 << n
        return doc, start, n

    while there:
        piece = take(longest)
        size = next(t for t in tiers if t >= piece[2])
        window, left = [piece], size - piece[2]
        while left and there:
            piece = take(left)
            if piece is None:  # all that is left is longer than the gap
                doc, start, n = take(longest)
                piece = (doc, start, left)
                pool[n - left].append((doc, start + left))
                there |= 1 << (n - left)
            window.append(piece)
            left -= piece[2]
        windows += [window] if not left else _divided(window, size - left)
    return windows


def _divided(pieces: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """Windows of powers of two that hold the pieces."""
    out, queue = [], pieces[::-1]
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        out.append([])
        while size:
            doc, start, n = queue.pop()
            part = min(n, size)
            out[-1].append((doc, start, part))
            if n > part:
                queue.append((doc, start + part, n - part))
            size -= part
    return out


def step_groups(sizes: list[int], step: int = STEP) -> list[int]:
    """A group for each window; groups hold nearly equal numbers of tokens."""
    heap = [(0, g) for g in range(max(1, -(-sum(sizes) // step)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        held, group = heapq.heappop(heap)
        out[i] = group
        heapq.heappush(heap, (held + sizes[i], group))
    return out


def packed(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", tiers: tuple[int, ...] = TIERS, step: int = STEP, with_ids: bool = False) -> DataFrame:
    """Per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, window (tokens), step_group, and with ``with_ids`` the ids."""
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers must be ascending powers of two")
    bound_batches(docs.sparkSession)
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        tokens = worker_state(f"tokens {tokenizer}", lambda: WordTokens(tokenizer))
        sequence, group = task << 40, task << 40
        for _, table in chunks(batches, text):
            ids, bounds = tokenize(table.column(1), tokens)
            windows = pack(np.diff(bounds).tolist(), tiers)
            sizes = [sum(p[2] for p in w) for w in windows]
            groups = step_groups(sizes, step)
            at, raw = bounds.tolist(), memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            doc, columns, parts = [], [[] for _ in names], []
            for number, (window, size, own) in enumerate(zip(windows, sizes, groups, strict=True)):
                offset = 0
                for d, start, n in window:
                    a = at[d] + start
                    doc.append(d)
                    for column, value in zip(columns, (start, n, zlib.crc32(raw[4 * a : 4 * (a + n)]), at[d + 1] - at[d], sequence + number, offset, size, group + own)):
                        column.append(value)
                    if with_ids:
                        parts.append(ids[a : a + n].astype(np.int32))
                    offset += n
            sequence, group = sequence + len(windows), group + max(groups, default=-1) + 1
            arrays = [table.column(0).combine_chunks().take(pa.array(doc, pa.int64())), *[pa.array(c, pa.int64()) for c in columns]]
            found = [key, *names]
            if with_ids:
                arrays, found = [*arrays, pa.array(parts, pa.list_(pa.int32()))], [*found, "ids"]
            yield from pa.Table.from_arrays(arrays, names=found).to_batches(max_chunksize=10_000)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, " + ", ".join(f"`{n}` long" for n in names) + ", ids array<int>" * with_ids
    return docs.select(key, text).mapInArrow(run, schema)
