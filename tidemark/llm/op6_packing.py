"""Packing token sequences by minimum bin slack.

Documents are cut into full windows and one remainder.  Each task packs what it
reads, some millions of tokens at a time: a bitset subset-sum over the multiset
of remaining lengths finds the combination that fills a window closest to
capacity, counts are backtracked from the stored bitsets, and the combination is
repeated as often as the counts allow.  Slack that no combination fills is
filled by cutting a longer remainder, whose rest is a length like any other.
What does not fill a window waits for the task's next documents; its last,
incomplete window is cut into powers of two.  Nothing is shuffled, and nothing
is known globally: a sequence is named by its task and a number.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, binary_column, slices, tidy
from .words import word_hashes, word_spans

CACHE = 600_000
#: Tokens that a task packs together.
CHUNK = 4 << 20
#: Stands between texts; a text that holds it is not plain.
GAP = "\x1e"
_tokenizers: dict = {}


class Encoder:
    """Token ids of whole texts with a bounded cache of words.

    The tokenizer drops white space and never merges across it, so a text's ids
    are those of its words in a row; new words go through the merge model many
    at a time, already lower case and normal.  Texts for which this is not plain
    (control characters, not in NFC, lower case that depends on context, special tokens, letters
    beyond U+2FFF) are encoded as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        bare = json.loads(self.t.to_str()) | {"normalizer": None, "added_tokens": []}
        self.merges = Tokenizer.from_str(json.dumps(bare | {"pre_tokenizer": {"type": "WhitespaceSplit"}}))
        self.bare = Tokenizer.from_str(json.dumps(bare))  # for what is in lower case already
        vocab = self.t.get_vocab()
        self.end = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.end[i] = token.endswith("</w>")
        # the characters that byte-level models use for bytes
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        low = [i for i in range(256) if i not in shown]
        self.shown = np.array([i if i in shown else 256 + low.index(i) for i in range(256)], dtype="<u4")
        self.shown[32] = 32
        category = [unicodedata.category(chr(i))[0] for i in range(0x3000)]
        unknown = [i for i in range(0x3000) if unicodedata.category(chr(i)) == "Cn"]
        self.unknown = re.compile("[" + "".join(map(chr, unknown)) + "]")  # another version of Unicode may have them
        self.kind = np.array([0 if chr(i).isspace() else 1 if c == "L" else 2 if c == "N" else 3 for i, c in enumerate(category)], np.uint8)
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes of words, in order
        self.place = np.zeros(0, np.int64)  # their places in begin and size
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def _plain(self, texts: list[str], model=None) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in (model or self.t).encode_batch_fast(texts, add_special_tokens=False)]

    def _find(self, h: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[at] == h, self.place[at], -1)

    def _merge(self, line: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each word of the line ends in them); a word has no white space."""
        u = np.frombuffer(line.encode("utf-32-le"), "<u4")
        kind = self.kind[u]
        cut = np.flatnonzero((kind[1:] != 0) & (kind[:-1] != 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))) + 1
        last = np.flatnonzero(u == 32)  # one after each word
        first = np.concatenate([[0], last[:-1] + 1])
        blank = np.concatenate([[0], np.cumsum((kind != 0) & np.concatenate([[True], (kind[:-1] == 0)]))])  # runs of letters begun
        parts = blank[last] - blank[first] + np.searchsorted(cut, last) - np.searchsorted(cut, first)
        u = np.insert(np.where(kind == 0, 32, u).astype("<u4"), cut, 32)
        shown = self.shown[np.frombuffer(u.tobytes().decode("utf-32-le").encode(), np.uint8)]
        ids = np.array(self.merges.encode_batch_fast([shown.tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.concatenate([[0], np.flatnonzero(self.end[ids]) + 1])
        if len(ends) != parts.sum() + 1:  # a vocabulary that marks word ends otherwise
            each = self._plain(line.split(" ")[:-1], self.bare)
            return np.frombuffer(b"".join(each), "<u4"), np.cumsum([len(x) // 4 for x in each])
        return ids, ends[np.cumsum(parts)]

    def _index(self, h: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places in the cache of distinct words (in order of their hashes), new ones added."""
        if len(self.known) > CACHE:
            self._clear()
        at = self._find(h)
        new = np.flatnonzero(at < 0)
        if len(new):
            # words with an apostrophe go through the tokenizer's own pattern, the others are cut where the kind of letter changes
            quotes = np.concatenate([[0], np.cumsum(raw == 39)])
            quoted = quotes[end[new]] > quotes[start[new]]
            new = np.concatenate([new[~quoted], new[quoted]])
            plain, rest = new[: len(new) - quoted.sum()], new[len(new) - quoted.sum() :]
            ids, stop = self._merge(_line(raw, start[plain], end[plain])) if len(plain) else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
            more = self._plain(_line(raw, start[rest], end[rest]).split(" ")[:-1], self.bare) if len(rest) else []
            stop = np.concatenate([stop, len(ids) + np.cumsum([len(x) // 4 for x in more], dtype=np.int64)])
            ids = np.concatenate([ids, np.frombuffer(b"".join(more), "<u4")])
            begin = np.concatenate([[0], stop[:-1]])
            at[new] = len(self.begin) + np.arange(len(new))
            self.begin = np.concatenate([self.begin, begin + len(self.ids)])
            self.size = np.concatenate([self.size, stop - begin])
            self.ids = np.concatenate([self.ids, ids])
            new.sort()
            where = np.searchsorted(self.known, h[new])
            self.known, self.place = np.insert(self.known, where, h[new]), np.insert(self.place, where, at[new])
        return at

    def __call__(self, texts: list[str]) -> list[bytes]:
        odd = [i for i, t in enumerate(texts) if not t.isascii() and ("Σ" in t or "İ" in t or self.unknown.search(t) or not unicodedata.is_normalized("NFC", t)) or "<|" in t or GAP in t]
        plain = list(texts)
        for i in odd:
            plain[i] = ""
        raw = np.frombuffer(bytearray(GAP.join(plain).lower().encode()), np.uint8)
        gaps = np.flatnonzero(raw == ord(GAP))  # between texts alone
        raw[gaps] = 32
        at = np.concatenate([[0], gaps + 1, [len(raw)]])
        # control characters, C1 ones too, and what lies beyond U+2FFF
        strange = (raw < 32) & ((raw < 9) | (raw > 13)) | (raw == 127) | (raw > 0xE2)
        strange[:-1] |= (raw[:-1] == 0xC2) & (raw[1:] < 0xA0)
        start, end, doc = word_spans(raw, at)
        if strange.any():
            more = np.unique(np.searchsorted(at, np.flatnonzero(strange), side="right") - 1)
            odd += more.tolist()
            keep = ~np.isin(doc, more)
            start, end, doc = start[keep], end[keep], doc[keep]
        if len(start):
            h, first, which = np.unique(word_hashes(raw, start, end), return_index=True, return_inverse=True)
            index = self._index(h, raw, start[first], end[first])[which]
            n = self.size[index]
            upto = np.cumsum(n)
            ids = self.ids[np.repeat(self.begin[index] - (upto - n), n) + np.arange(upto[-1])]
            cut = np.concatenate([[0], upto])[np.searchsorted(doc, np.arange(len(texts) + 1), side="left")]
            out = [ids[a:b].tobytes() for a, b in zip(cut.tolist(), cut[1:].tolist())]
        else:
            out = [b""] * len(texts)
        if odd:
            for i, x in zip(odd, self._plain([texts[i] for i in odd])):
                out[i] = x
        return out


def _line(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> str:
    """The words, each followed by a space."""
    n = end - start
    width = n + 1
    upto, done = np.cumsum(width), np.cumsum(n) - n
    line = np.full(upto[-1] if len(n) else 0, 32, np.uint8)
    each = np.arange(n.sum())
    line[np.repeat(upto - width - done, n) + each] = raw[np.repeat(start - done, n) + each]
    return line.tobytes().decode()


def encoder(path: str) -> Encoder:
    if path not in _tokenizers:
        _tokenizers[path] = Encoder(path)
    return _tokenizers[path]


def fill(counts: dict[int, int], window: int) -> dict[int, int]:
    """The multiset {length: count} within ``counts`` whose sum is closest to ``window``, never above; long lengths first."""
    steps, reach, mask = [], 1, (1 << window + 1) - 1
    for length in sorted(counts, reverse=True):
        left, k = min(counts[length], window // length), 1
        while left > 0:  # binary splitting of the count
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= reach << length * k & mask
            left, k = left - k, k * 2
        if reach >> window & 1:
            break
    at, out = reach.bit_length() - 1, defaultdict(int)
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            out[length] += k
            at -= length * k
    return dict(out)


class Packer:
    """Packs one task's documents into sequences named from ``first`` on."""

    def __init__(self, window: int, first: int = 0):
        self.window, self.next, self.tokens = window, first, 0
        self.docs: list[tuple] = []  # (id, ids)
        self.rest: dict[int, list[tuple[int, int]]] = defaultdict(list)  # length -> (place in docs, start) of remainders
        self.rows: list[tuple] = []  # (place in docs, start, length, sequence, offset)

    def take(self, doc, ids: bytes) -> None:
        k, n = len(self.docs), len(ids) // 4
        self.docs.append((doc, ids))
        self.tokens += n
        whole, rest = divmod(n, self.window)
        for i in range(whole):
            self._place([(k, i * self.window, self.window)])
        if rest:
            self.rest[rest].append((k, whole * self.window))

    def _place(self, pieces: list[tuple[int, int, int]]) -> None:
        at = 0
        for k, start, n in pieces:
            self.rows.append((k, start, n, self.next, at))
            at += n
        self.next += 1

    def fill(self, last: bool) -> None:
        """Fills windows while the remainders have the tokens; with ``last`` nothing is left."""
        held, window = {n: x for n, x in self.rest.items() if x}, self.window
        total = sum(n * len(x) for n, x in held.items())
        while total >= window:
            pattern = fill({n: len(x) for n, x in held.items()}, window)
            slack = window - sum(n * c for n, c in pattern.items())
            times = min(len(held[n]) // c for n, c in pattern.items())
            if slack:  # what is left over is longer than the slack, or the pattern would hold it
                cut = min(n for n, x in held.items() if len(x) > pattern.get(n, 0))
                times = min(times, len(held[cut]) // (pattern.get(cut, 0) + 1))
            for _ in range(times):
                pieces = [(*held[n].pop(), n) for n, c in pattern.items() for _ in range(c)]
                if slack:
                    k, start = held[cut].pop()
                    pieces.append((k, start, slack))
                    held.setdefault(cut - slack, []).append((k, start + slack))
                self._place(pieces)
            total -= times * window
            held = {n: x for n, x in held.items() if x}
        self.rest = defaultdict(list, held)
        if last and total:
            items = [(k, start, n) for n in sorted(held, reverse=True) for k, start in held[n]]
            for size in (1 << b for b in reversed(range(total.bit_length())) if total >> b & 1):
                pieces, room = [], size
                while room:
                    k, start, n = items.pop(0)
                    pieces.append((k, start, min(n, room)))
                    if n > room:
                        items.insert(0, (k, start + room, n - room))
                    room -= min(n, room)
                self._place(pieces)
            self.rest.clear()

    def pieces(self, last: bool):
        """Record batches of what is placed; documents of which something waits are kept."""
        self.fill(last)
        out, size, blob = [[] for _ in range(6)], [0], []

        def batch():
            a = [pa.array(c, pa.int64()) for c in out]
            return pa.RecordBatch.from_arrays([a[0], a[1], a[2], binary_column(b"".join(blob), np.cumsum(size)), a[3], a[4], a[5]], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        held = 0
        for k, start, n, sequence, offset in self.rows:
            doc, ids = self.docs[k]
            for column, v in zip(out, (doc, start, n, len(ids) // 4, sequence, offset)):
                column.append(v)
            blob.append(ids[start * 4 : (start + n) * 4])
            size.append(n * 4)
            held += n * 4
            if held > 4 << 20:
                yield batch()
                out, size, blob, held = [[] for _ in range(6)], [0], [], 0
        if blob:
            yield batch()
        places = sorted({k for x in self.rest.values() for k, _ in x})
        new = {k: i for i, k in enumerate(places)}
        self.docs = [self.docs[k] for k in places]
        self.rest = defaultdict(list, {n: [(new[k], start) for k, start in x] for n, x in self.rest.items()})
        self.rows, self.tokens = [], 0


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, work: Work | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of whole documents in windows without padding.

    Null and empty texts are the end id alone; null ids stay null; repeated rows
    are packed as often as they come; other columns, whatever their names, are
    ignored; an empty table gives no pieces.  Every sequence is full but a
    task's last few, whose lengths are powers of two.  Sequences are numbered by
    task (from the 33rd bit on) and in order there, so the numbers have gaps.
    """
    work or Work(docs.sparkSession, "packing")  # ships the package, bounds batches

    def run(batches):
        encode = encoder(tokenizer_path)
        packer, end = Packer(window, TaskContext.get().partitionId() << 33), np.array([end_id], dtype="<u4").tobytes()
        for batch in slices(batches, 1, 4 << 20):
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                packer.take(doc, ids + end)
            if packer.tokens >= CHUNK:
                yield from packer.pieces(False)
                tidy()
        yield from packer.pieces(True)
        tidy()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
