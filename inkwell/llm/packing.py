"""Packing tokens into fixed windows by Karmarkar-Karp multiway differencing.

Every partition tokenizes its documents and packs them in groups, so nothing is shuffled, and which documents share a
window depends on how the rows are partitioned. A document's ids, closed by ``end_id``, are first cut into full windows.
What is left of the group's documents is dealt by differencing: each rest starts as a partition with one loaded window;
the two partitions with the largest imbalance merge, heaviest window onto lightest, until one partition of near-equal
windows is left. The window count begins at the least that could hold all tokens and rises as long as a window exceeds the
capacity. The room that this leaves is then closed from the lightest windows, by cutting, until all windows but one are
full. The pieces of that one go on to the partition's next group; the last group of a partition cuts them into lengths that
are powers of two, which need no padding. So nothing is padded, and a partition has at most one sequence of each such length.

Null texts are empty texts: one piece that holds end_id alone. Rows are packed one by one, so repeated rows and ids, also
null ones, are packed each time they occur. Very long texts are cut whole. Only doc_id and text are read. sequence_id is
unique over all partitions. An empty table has no pieces.
"""

from __future__ import annotations

import heapq
import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from inkwell.llm.common import ship

ship(__name__)

WINDOW = 2048
END_ID = 1
#: Rests packed together, at least, and the windows that they fill at least; one more document closes the group.
GROUP = 300
GROUP_WINDOWS = 16
#: Distinct words whose ids a worker remembers.
MEMORY = 300_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Deal items to k windows by multiway differencing; the windows, as lists of item numbers, with near-equal sums.

    A partial partition is kept as its loaded windows in falling order; the windows it doesn't name are empty.
    """
    if k <= 1 or not sizes:
        return [list(range(len(sizes)))] + [[] for _ in range(k - 1)]
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free = k - len(a)  # empty windows of a take the heaviest of b; the rest of b goes, heaviest first, onto a's lightest
        out = a + b[:free] if len(b) <= free else a + b[:free]
        for j, (s, items) in enumerate(b[free:]):
            at = len(a) - 1 - j
            out[at] = (a[at][0] + s, a[at][1] + items)
        out.sort(key=lambda w: -w[0])
        least = out[-1][0] if len(out) == k else 0
        n += 1
        heapq.heappush(heap, (least - out[0][0], n, out))
    windows = [items for _, items in heap[0][2]]
    return windows + [[] for _ in range(k - len(windows))]


def balanced(sizes: list[int], window: int) -> list[list[int]]:
    """Differencing to the smallest number of windows, from the least possible on, that exceeds no capacity."""
    k = max(1, -(-sum(sizes) // window))
    while True:
        windows = difference(sizes, k)
        if max(sum(sizes[i] for i in w) for w in windows) <= window:
            return windows
        k += 1  # capacity exceeded


def pack(rests: list[tuple[int, int, int]], window: int = WINDOW) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """rests: (owner, start, length), each shorter than a window. Full windows of such pieces, and the pieces left over."""
    if not rests:
        return [], []
    windows = [[rests[i] for i in w] for w in balanced([r[2] for r in rests], window) if w]
    windows.sort(key=lambda w: -sum(p[2] for p in w))
    # The fullest windows are filled from the lightest ones, whose shortest pieces go first.
    full, last, pool = [], len(windows), []
    while len(full) < last:
        mine = windows[len(full)]
        gap = window - sum(p[2] for p in mine)
        while gap:
            if not pool:
                if last - 1 <= len(full):
                    return full, mine
                last -= 1
                pool = sorted(windows[last], key=lambda p: -p[2])
            owner, start, length = pool.pop()
            take = min(gap, length)
            if take < length:
                pool.append((owner, start, length - take))
            mine.append((owner, start + length - take, take))
            gap -= take
        full.append(mine)
    return full, pool


def powers(rest: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Pieces as sequences whose lengths are different powers of two."""
    total, rest, out = sum(p[2] for p in rest), list(rest), []
    for size in (1 << i for i in range(total.bit_length() - 1, -1, -1)):
        if total & size:
            got, need = [], size
            while need:
                owner, start, length = rest.pop()
                take = min(need, length)
                if take < length:
                    rest.append((owner, start, length - take))
                got.append((owner, start + length - take, take))
                need -= take
            out.append(got)
    return out


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write bytes as printable characters: those that are printable stay, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            out[chr(256 + n)] = b
            n += 1
    return out


class Ids:
    """Token ids of texts as little-endian 16-bit bytes, the same as the tokenizer file gives.

    Words behind a single space are tokenized independently of what is around them, so their ids are remembered. New
    ones go through the merge ranks of the file; texts with other white space runs are split only where that is safe, and
    what looks like a special token goes to the tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"] for x in spec.get("added_tokens", [])}
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        if max(self.whole.get_vocab().values()) >= 1 << 16:
            raise ValueError("ids need 16 bits at most here")
        #: Fixed value: the split pattern of the byte-level pre-tokenizer.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.core = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.special, self.known, self.held = tuple(special), {}, 0

    def _new(self, piece: str) -> bytes:
        if any(s in piece for s in self.special):
            return array("H", self.whole.encode(piece, add_special_tokens=False).ids).tobytes()
        return array("H", self.core.encode_ordinary(piece)).tobytes()

    def of(self, text: str) -> bytes:
        known, parts = self.known, text.split(" ")
        if len(known) > MEMORY or self.held > 40 * MEMORY:
            known.clear()
            self.held = 0
        if len(parts) < 2 or any(not p or p[0].isspace() or p[-1].isspace() for p in parts):
            pieces = self._safe(parts)
        else:
            pieces = [parts[0], *[" " + p for p in parts[1:]]]
        for p in pieces:
            if p not in known:
                known[p] = self._new(p)
                self.held += len(p)
        return b"".join([known[p] for p in pieces])

    @staticmethod
    def _safe(parts: list[str]) -> list[str]:
        """Cut before a space only if no white space is beside it."""
        out = [parts[0]]
        for p in parts[1:]:
            if p and out[-1] and not p[0].isspace() and not out[-1][-1].isspace():
                out.append(" " + p)
            else:
                out[-1] += " " + p
        return out


def _packer(path: str, window: int, end_id: int, group: int):
    end = array("H", [end_id]).tobytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = Ids(path)
        sequence = TaskContext.get().partitionId() << 40
        docs: dict[int, tuple[int, int, bytes, int]] = {}  # rests of the open group
        out: list[tuple] = []

        def flush(end_of_partition: bool) -> None:
            nonlocal sequence, number, held
            windows, rest = pack([(i, d[1], (len(d[2]) >> 1)) for i, d in docs.items()], window)
            left = []
            for w in windows + powers(rest) if end_of_partition else windows:
                offset = 0
                for owner, start, length in w:
                    doc_id, base, ids, n = docs[owner]
                    at = (start - base) << 1
                    crc = zlib.crc32(np.frombuffer(ids[at : at + (length << 1)], "<u2").astype("<u4").tobytes())
                    out.append((doc_id, start, length, crc, n, sequence, offset))
                    offset += length
                sequence += 1
            for owner, start, length in rest if not end_of_partition else ():
                doc_id, base, ids, n = docs[owner]
                at = (start - base) << 1
                left.append((doc_id, start, ids[at : at + (length << 1)], n))
            docs.clear()
            held = sum(len(d[2]) >> 1 for d in left)
            for d in left:
                docs[number] = d
                number += 1

        number = held = 0
        for f in frames:
            for doc_id, text in zip(f["doc_id"].astype("Int64"), f["text"]):
                ids = ids_of.of(text or "") + end
                n = len(ids) >> 1
                full = n // window
                for i in range(full):
                    part = np.frombuffer(ids, "<u2", window, i * window * 2).astype("<u4")
                    out.append((doc_id, i * window, window, zlib.crc32(part.tobytes()), n, sequence, 0))
                    sequence += 1
                if n > full * window:
                    docs[number] = (doc_id, full * window, ids[full * window * 2 :], n)
                    number += 1
                    held += n - full * window
                    if len(docs) >= group and held >= GROUP_WINDOWS * window:
                        flush(False)
            if len(out) > 20_000:
                yield _frame(out)
                out.clear()
        flush(True)
        if out:
            yield _frame(out)

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return f.astype({"doc_id": "Int64"})


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. tokenizer: path of a byte-level BPE file on every machine."""
    return docs.select("doc_id", "text").mapInPandas(_packer(tokenizer, window, end_id, group), SCHEMA)
