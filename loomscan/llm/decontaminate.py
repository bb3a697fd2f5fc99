"""Benchmark decontamination (operator 8): q-gram lemma filtering and banded alignment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import begin, freed, ship, table

Q = 12
EDITS = 0.05  # edit budget as a share of an item's length
PIECE = 250_000  # characters of texts searched at once, more where items are longer
BLOCK_CHARS = 4_000_000  # of benchmark items a pass holds
TABLE_BITS = 22
RUN = 50  # characters of an item that are a quotation of it wherever they stand together
REPEATS = 4  # times that a gram is listed in an item, and places at each end of a text's run of one gram
PAIRS = 200_000  # hits looked at together, more where one item has more
MANY = 16  # bands of an item in a text, beyond which all its diagonals may be aligned at once
_P = np.uint64(0x9E3779B97F4A7C15)
_SPACE = re.compile(r"[^\S ]")
_BLANKS = re.compile("(?<= ) +")


def normal(text: str) -> str:
    """Lower case, and a blank for each white-space character; as long as the text."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return _SPACE.sub(" ", low)


def squeezed(low: str) -> str:
    """A normal text with one blank for each run of them."""
    return _BLANKS.sub("", low) if "  " in low else low


def places(low: str) -> np.ndarray:
    """Where the characters of the squeezed text, and its end, stand in the normal one."""
    blank = _codes(low) == 32
    keep = np.ones(len(low), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    return np.append(np.flatnonzero(keep), len(low))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each Q-gram, from those of 2, 4 and 8 characters."""
    if len(codes) < Q:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        p2, p4 = _P * _P, _P * _P * _P * _P
        h2 = codes[:-1] * _P + codes[1:]
        h4 = h2[:-2] * p2 + h2[2:]
        h8 = h4[:-4] * p4 + h4[4:]
        h = h8[: len(codes) - Q + 1] * p4 + h4[8 : 8 + len(codes) - Q + 1]
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)


def budget(n: int) -> int:
    """Edits allowed in an item of n characters, fewer where else no Q-gram would have to be shared."""
    return max(0, min(int(n * EDITS), (n - Q) // Q))


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, anchored: bool = False) -> tuple[int, int]:
    """(edits, end) of the best alignment of the whole item with a part of text, on diagonals low to high (text - item).

    Banded: a row of costs an item character. end is the place in text behind the part; edits may exceed any budget.
    An anchored part begins where the text does.
    """
    steps = np.arange(high - low + 1)
    far = len(item) + len(text) + 1
    skipped = steps + low
    cost = np.where((skipped >= 0) & (skipped <= len(text)), skipped if anchored else 0, far)
    padded = np.concatenate([text.astype(np.int64), [-1]])
    for i, c in enumerate(item.astype(np.int64)):
        at = steps + low + i  # the text position before this row's character, on each diagonal
        inside = (at >= 0) & (at < len(text))
        same = padded[np.where(inside, at, len(text))] == c
        new = np.where(inside, cost + ~same, far)
        new[:-1] = np.minimum(new[:-1], cost[1:] + 1)  # item character left out: position at+1 on the diagonal above
        new = np.where((at + 1 >= 0) & (at + 1 <= len(text)), new, far)
        cost = np.minimum.accumulate(new - steps) + steps  # text characters left out
    best = int(cost.argmin())
    return int(cost[best]), best + low + len(item)


def begins_at(item: np.ndarray, text: np.ndarray, end: int, cost: int) -> int:
    """Where the part of text begins that ends at `end` and aligns with the item at that cost."""
    if not cost:
        return end - len(item)
    before = text[max(0, end - len(item) - cost) : end]
    return end - align(item[::-1], before[::-1], -cost, cost, True)[1]


def scan(item: np.ndarray, text: np.ndarray, edits: int) -> Iterator[tuple[int, int]]:
    """(end, edits) of parts of text within so many edits of the item, ends more than half an item apart.

    All diagonals at once: a column of the alignment's cost differences is two whole numbers with a bit an item
    character (Myers 1999), so a text character costs some operations on them, however often the item fits.
    """
    m = len(item)
    bits = {int(c): int.from_bytes(np.packbits(item == c, bitorder="little").tobytes(), "little") for c in np.unique(item)}
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, cost = full, 0, m
    last, best, until = None, None, 0
    for end, c in enumerate(text.tolist(), 1):
        eq = bits.get(c, 0)
        across = (((eq & up) + up) ^ up) | eq
        plus, minus = (down | ~(across | up)) & full, up & across
        if plus & top:
            cost += 1
        elif minus & top:
            cost -= 1
        plus, minus, eq = plus << 1, minus << 1, eq | down
        up, down = (minus | ~(eq | plus)) & full, plus & eq & full
        if best and end > until:
            yield best[1], best[0]
            last, best = best[1], None
        if cost <= edits and (last is None or end - last > m // 2):
            if best is None:
                best, until = (cost, end), end + edits
            elif cost < best[0]:
                best = cost, end
    if best:
        yield best[1], best[0]


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for count[0] numbers, and so on."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading characters are the same."""
    n, step = min(len(a), len(b)), 64
    done = 0
    while done < n:
        differ = np.flatnonzero(a[done : min(n, done + step)] != b[done : min(n, done + step)])
        if len(differ):
            return done + int(differ[0])
        done, step = done + step, 2 * step
    return n


class Index:
    """Q-grams of a block of benchmark items: at most BLOCK_CHARS characters, or one item. Equal items are one.

    Hits are pairs of a place in a text and one in an item, so what repeats on both sides would make a square of them.
    Grams that an item has more than REPEATS times aren't listed for it, nor places of a text deeper than REPEATS in a
    run of one gram. The q-gram lemma then asks for so many hits less as places of the item are left out; where that
    leaves nothing to ask for, the texts' windows that hold enough of the item's grams are aligned on all diagonals.
    """

    def __init__(self, items: list[tuple[int | None, str]]):
        numbers: dict[str, int] = {}
        self.ids: list[list[int | None]] = []
        for i, t in items:
            k = numbers.setdefault(normal(t), len(numbers))
            if k == len(self.ids):
                self.ids.append([])
            self.ids[k].append(i)
        texts = list(numbers)
        self.short = {t: k for t, k in numbers.items() if t.strip() and len(t) < Q}
        self.codes = [_codes(t) for t in texts]
        self.sizes = np.array([len(c) for c in self.codes], np.int64)
        self.edits = np.array([budget(n) for n in self.sizes], np.int64)
        self.need = self.sizes - Q + 1 - self.edits * Q
        hashes = [grams(c) for c in self.codes]
        h = np.concatenate([np.empty(0, np.uint64), *hashes])
        order = np.argsort(h, kind="stable")
        h = h[order]
        item = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])[order]
        pos = np.concatenate([np.empty(0, np.int64), *[np.arange(len(x)) for x in hashes]])[order]
        self.hash, first = np.unique(h, return_index=True)
        gram = np.repeat(np.arange(len(self.hash)), np.diff(np.append(first, len(h))))
        heads = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (item[1:] != item[:-1]))[: len(h)])
        size = np.diff(np.append(heads, len(h)))
        often, every = size > REPEATS, np.arange(len(self.hash) + 1)
        self.group_item, self.group_size = item[heads].astype(np.int32), size.astype(np.int32)
        self.group_first = np.searchsorted(gram[heads], every)
        listed = np.repeat(~often, size)
        self.item, self.pos = item[listed].astype(np.int32), pos[listed].astype(np.int32)
        self.first = np.searchsorted(gram[listed], every)
        self.lost = np.bincount(item[heads][often], weights=size[often], minlength=len(texts)).astype(np.int64)
        self.dense = (self.sizes >= Q) & (self.need <= self.lost)
        self.has_dense = np.zeros(len(self.hash), bool)
        self.has_dense[gram[heads][self.dense[item[heads]]]] = True
        self.seen = np.zeros(1 << TABLE_BITS, bool)
        self.seen[self.hash >> np.uint64(64 - TABLE_BITS)] = True
        self.spread = np.maximum(8, self.sizes // 10)  # diagonals that a quotation's parts may lie apart
        self.most = np.maximum(2 * Q, (self.sizes + 1) // 2)
        self.reach = int(self.sizes.max() + max(4 * self.edits.max(), 2 * self.spread.max()) + Q) if texts else 0
        flat = [squeezed(t) for t in texts]
        self.flat = self if flat == texts else Index(list(enumerate(flat)))

    def finds(self, texts: list[str]) -> list[tuple[int, int, int, int, int | None]]:
        """(text, item, start, end, edits) of whole items as in search(), and of quotations, whose edits are None.

        White space that is more or less than the item's costs no edits here. Overlapping quotations of an item are one,
        and none where a whole item is found.
        """
        lows = [normal(t) for t in texts]
        odd = [k for k, t in enumerate(lows) if self.flat is not self or "  " in t]
        parts: dict[tuple[int, int], list[tuple[int, int]]] = {}
        found: dict[tuple[int, int], list[tuple[int, int, int | None]]] = {}

        def put(out, numbers, at, items=None) -> None:
            for k, j, a, b, e in out:
                k = numbers[k]
                a, b = at(k, a), at(k, b - 1) + 1
                for i in items[j] if items else (j,):
                    if e is None:
                        parts.setdefault((k, i), []).append((a, b))
                    elif all(b <= x or y <= a for x, y, _ in found.get((k, i), ())):
                        found.setdefault((k, i), []).append((a, b, e))

        put(self.search(lows, True), range(len(lows)), lambda k, x: x)
        where: dict[int, np.ndarray] = {}

        def unsqueezed(k: int, x: int) -> int:
            if k not in where:
                where[k] = places(lows[k])
            return int(where[k][x])

        if odd:
            put(self.flat.search([squeezed(lows[k]) for k in odd], True), odd, unsqueezed, None if self.flat is self else self.flat.ids)
        for key, spans in parts.items():
            merged: list[list[int]] = []
            for a, b in sorted(spans):
                if merged and a < merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            whole = list(found.get(key, ()))
            found.setdefault(key, []).extend((a, b, None) for a, b in merged if all(b <= x or y <= a for x, y, _ in whole))
        return [(k, i, *x) for (k, i), rows in found.items() for x in rows]

    def search(self, texts: list[str], quotations: bool = False) -> Iterator[tuple[int, int, int, int, int | None]]:
        """(text, item, start, end, edits) of each region that aligns within an item's edit budget, and of quotations."""
        held, size, most = [], 0, max(PIECE, 4 * self.reach)
        words = re.compile("|".join(map(re.escape, sorted(self.short, key=lambda t: (-len(t), t))))) if self.short else None
        for k, t in enumerate(texts):
            low = normal(t)
            if words:
                yield from ((k, self.short[m[0]], m.start(), m.end(), 0) for m in words.finditer(low) if not (low[: m.start()][-1:].isalnum() or low[m.end() : m.end() + 1].isalnum()))
            at = 0
            while True:  # long texts in pieces that overlap by more than a match can span
                piece = low[at : at + most]
                held.append((k, at, piece))
                size += len(piece)
                if size >= most:
                    yield from self._search(held, quotations)
                    held, size = [], 0
                if at + most >= len(low):
                    break
                at += most - self.reach
        yield from self._search(held, quotations)

    def _quotations(self, piece: np.ndarray, item: np.ndarray, pos: np.ndarray, at: np.ndarray, holes: bool, text_of) -> Iterator[tuple[int, int, int, int]]:
        """(piece, item, start, end) of quotations among the hits: shared Q-grams at pos of an item and at of a piece.

        A quotation is RUN characters in a run, or most of the item in one band of diagonals. With holes, for grams left
        out, runs are extended by the characters themselves.
        """
        shift = at - pos + self.sizes[item]
        order = np.lexsort((pos, shift, item, piece))
        p, i, d, x = piece[order], item[order], shift[order], pos[order]
        heads = np.concatenate([[0], np.flatnonzero((p[1:] != p[:-1]) | (i[1:] != i[:-1]) | (d[1:] != d[:-1]) | (x[1:] != x[:-1] + 1)) + 1])
        sizes = np.diff(np.append(heads, len(p))) + Q - 1
        wanted = (sizes >= RUN) | (self.lost[i[heads]] > 0) | holes
        for h, n in zip(heads[wanted].tolist(), sizes[wanted].tolist()):
            start, k = int(d[h] - self.sizes[i[h]] + x[h]), int(x[h])
            if self.lost[i[h]] or holes:
                own, text = self.codes[i[h]], text_of(p[h])
                back = _alike(own[:k][::-1], text[:start][::-1])
                n += back + _alike(own[k + n :], text[start + n :])
                start -= back
            if n >= RUN:
                yield int(p[h]), int(i[h]), start, start + n
        band = shift // self.spread[item]
        keys = np.stack([np.tile(piece, 2), np.tile(item, 2), np.concatenate([band, band - 1]), np.tile(pos, 2), np.tile(at, 2)], 1)
        keys = keys[np.lexsort(keys.T[::-1])]
        same = np.all(keys[1:, :3] == keys[:-1, :3], axis=1)
        heads = np.concatenate([[0], np.flatnonzero(~same) + 1])
        fresh = np.concatenate([[Q], np.where(same, np.minimum(keys[1:, 3] - keys[:-1, 3], Q), Q)])  # characters of the item that a hit adds
        covered = np.add.reduceat(fresh, heads)
        enough = covered >= self.most[keys[heads, 1]]
        first, last = np.minimum.reduceat(keys[:, 4], heads), np.maximum.reduceat(keys[:, 4], heads)
        for (q, j), a, b in zip(keys[heads[enough], :2].tolist(), first[enough].tolist(), last[enough].tolist()):
            yield q, j, a, b + Q

    def _chunks(self, entry: np.ndarray, times: np.ndarray) -> Iterator[np.ndarray]:
        """Numbers of entries so that an item's are together and those of a chunk make about PAIRS hits at most."""
        if times.sum() <= PAIRS:
            yield np.arange(len(entry))
            return
        item = self.item[entry]
        before = np.cumsum(np.bincount(item, weights=times, minlength=len(self.sizes))) // PAIRS
        order = np.argsort(item, kind="stable")
        yield from np.split(order, np.flatnonzero(np.diff(before[item[order]])) + 1)

    def _windows(self, at: np.ndarray, gram: np.ndarray, item: int) -> list[tuple[int, int]]:
        """Where a piece, whose known grams stand at `at`, has as many of the item's grams as the lemma asks for."""
        own = np.unique(np.searchsorted(self.hash, grams(self.codes[item])))
        x, need = at[np.isin(gram, own)], int(self.need[item])
        span = int(self.sizes[item] + self.edits[item])
        heads = np.flatnonzero(x[need - 1 :] - x[: len(x) - need + 1] <= span)
        out: list[list[int]] = []
        for a, b in zip((x[heads + need - 1] - span).tolist(), (x[heads] + span + Q).tolist()):
            a = max(0, a)
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return [(a, b) for a, b in out]

    def _search(self, pieces: list[tuple[int, int, str]], quotations: bool) -> Iterator[tuple[int, int, int, int, int | None]]:
        pieces = [p for p in pieces if len(p[2]) >= Q]
        if not pieces or not len(self.hash):
            return
        n = len(self.sizes)
        codes = _codes("\0".join(p[2] for p in pieces))  # no item has that character, so no Q-gram crosses
        starts = np.concatenate([[0], np.cumsum([len(p[2]) + 1 for p in pieces])])
        h = grams(codes)
        at = np.flatnonzero(self.seen[h >> np.uint64(64 - TABLE_BITS)])
        gram = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
        known = self.hash[gram] == h[at]
        at, gram = at[known], gram[known]
        if not len(at):
            return
        piece = np.searchsorted(starts, at, "right") - 1

        def text_of(p: int) -> np.ndarray:
            return codes[starts[p] : starts[p + 1] - 1]

        heads = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (gram[1:] != gram[:-1])))
        run = np.diff(np.append(heads, len(at)))
        inside = np.arange(len(at)) - np.repeat(heads, run)
        deep = (inside >= REPEATS) & (np.repeat(run, run) - inside > REPEATS)

        def groups(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(piece * n + item, size, times) of the items that have the grams at these places."""
            key, times = np.unique(piece[places] * len(self.hash) + gram[places], return_counts=True)
            p, g = key // len(self.hash), key % len(self.hash)
            count = self.group_first[g + 1] - self.group_first[g]
            k = _spread(self.group_first[g], count)
            return np.repeat(p, count) * n + self.group_item[k], self.group_size[k], np.repeat(times, count)

        # hits that the lemma can't ask for, by piece and item
        key, size, _ = groups(np.flatnonzero(deep))
        lost_key, number = np.unique(key[size <= REPEATS], return_inverse=True)
        lost = np.bincount(number, weights=size[size <= REPEATS], minlength=len(lost_key)).astype(np.int64)

        def asked(key: np.ndarray) -> np.ndarray:
            out = self.need[key % n] - self.lost[key % n]
            if len(lost_key):
                k = np.minimum(np.searchsorted(lost_key, key), len(lost_key) - 1)
                out = out - np.where(lost_key[k] == key, lost[k], 0)
            return out

        whole = set(lost_key[asked(lost_key) <= 0].tolist())
        if self.dense.any():
            key, size, times = groups(np.flatnonzero(self.has_dense[gram]))
            key, number = np.unique(key, return_inverse=True)
            shared = np.bincount(number, weights=times, minlength=len(key))
            whole |= set(key[self.dense[key % n] & (shared >= self.need[key % n])].tolist())

        order = np.flatnonzero(~deep)
        order = order[np.argsort(gram[order], kind="stable")]
        listed, first, times = np.unique(gram[order], return_index=True, return_counts=True)
        count = self.first[listed + 1] - self.first[listed]
        entry, first, times = _spread(self.first[listed], count), np.repeat(first, count), np.repeat(times, count)
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for part in self._chunks(entry, times) if len(entry) else ():
            some = order[_spread(first[part], times[part])]
            e = np.repeat(entry[part], times[part])
            where, in_piece, item, pos = at[some], piece[some], self.item[e].astype(np.int64), self.pos[e].astype(np.int64)
            if quotations:
                for p, i, a, b in self._quotations(in_piece, item, pos, where - starts[in_piece], bool(deep.any()), text_of):
                    k, offset, _ = pieces[p]
                    yield k, i, offset + a, offset + b, None
            width = np.maximum(self.edits[item], 1)
            diagonal = where - starts[in_piece] - pos + self.sizes[item]  # 0 or more
            band = diagonal // width
            # bands are two widths long and overlap by one, so any match within the budget has all its hits in one of them
            keys = np.stack([np.tile(in_piece, 2), np.tile(item, 2), np.concatenate([band, band - 1]), np.tile(pos, 2)], 1)
            keys = np.unique(keys[keys[:, 2] >= -1], axis=0)
            new = np.flatnonzero(np.any(keys[1:, :3] != keys[:-1, :3], axis=1)) + 1
            begins = np.concatenate([[0], new])
            counts = np.diff(np.concatenate([begins, [len(keys)]]))
            need = asked(keys[begins, 0] * n + keys[begins, 1])
            bands: dict[tuple[int, int], list[int]] = {}
            for p, i, b, _ in keys[begins[(counts >= need) & (need > 0)]].tolist():
                bands.setdefault((p, i), []).append(b)
            for (p, i), some in bands.items():
                text, edits, w, m = text_of(p), int(self.edits[i]), max(1, int(self.edits[i])), int(self.sizes[i])
                if len(some) > MANY and len(some) * m * 10 > len(text):
                    whole.add(p * n + i)  # dearer than all diagonals at once
                    continue
                for b in some:
                    low, high = b * w - m - edits, (b + 2) * w - m + edits
                    left = max(0, low)
                    cost, end = align(self.codes[i], text[left : max(left, high + m + edits)], low - left, high - left)
                    if cost <= edits:
                        found.setdefault((p, i), []).append((left + end, cost))
        for key in sorted(whole):
            p, i = divmod(key, n)
            here = slice(*np.searchsorted(piece, (p, p + 1)))
            for a, b in self._windows(at[here] - starts[p], gram[here], i):
                found.setdefault((p, i), []).extend((a + end, cost) for end, cost in scan(self.codes[i], text_of(p)[a:b], int(self.edits[i])))
        for (p, i), ends in found.items():
            k, offset, _ = pieces[p]
            last = None
            for end, cost in sorted(ends):
                if last is None or end - last > self.sizes[i] // 2:
                    yield k, i, offset + begins_at(self.codes[i], text_of(p), end, cost), offset + end, cost
                    last = end


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", min_chars: int = Q) -> Iterator[Index]:
    """Indexes of the benchmark, a bounded block at a time, however large it is."""
    block: list[tuple[int, str]] = []
    size = 0
    for i, t in benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).filter(F.length(text_col) >= min_chars).toLocalIterator():
        if block and size + len(t) > BLOCK_CHARS:
            yield Index(block)
            block, size = [], 0
        block.append((i, t))
        size += len(t)
    if block:
        yield Index(block)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", quotations: bool = False, min_chars: int = Q) -> DataFrame:
    """Passages of documents that are benchmark items, but for a few edits: id, item_id, start, end, edits, row_hash.

    A document matches if a part of it, in lower case and with blanks for white space, is within 5 % edits of a whole
    item. By the q-gram lemma such a part shares |item| - 11 - 12 * edits of the item's 12-grams, in a band of diagonals
    as wide as the edits allow; bands that have so many are aligned. What repeats in items and texts is bounded as Index
    says, without a loss. Places are code points of the text, start and end those of the alignment. Overlapping finds
    of an item are one.

    With quotations, parts of items count too, and runs of white space are as one blank: RUN characters of the item
    together, or 12-grams that cover half of the item, 24 characters at least, on diagonals not more than a tenth of the
    item apart. 12-grams that the item has more than 4 times, as in rules of dashes, are no evidence by themselves, only
    characters between others. Start and end are those of the shared 12-grams, edits null.

    The benchmark is searched in blocks of bounded size against all documents, one pass without a shuffle each; long
    texts are searched in overlapping pieces. Null or short texts match nothing. Items of fewer than min_chars characters
    are no evidence and are left out; those of fewer than 12 that are not left out match exactly, as whole words. Equal
    items all match; an empty benchmark or table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    schema = f"{id_col} long, item_id long, start long, end long, edits int, row_hash long"
    out = spark.createDataFrame([], schema)
    for index in benchmark_blocks(benchmark, min_chars=min_chars):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            begin("decontaminate")
            index = shared.value
            for batch in freed(batches):
                for k in range(0, batch.num_rows, 512):
                    ids, texts, hashes = (c.to_pylist() for c in batch.slice(k, 512).columns)
                    found = [(ids[d], item, a, b, e, hashes[d]) for d, i, a, b, e in (index.finds if quotations else index.search)([t or "" for t in texts]) for item in index.ids[i]]
                    if found:
                        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=[id_col, "item_id", "start", "end", "edits", "row_hash"])

        out = out.union(rows.mapInArrow(run, schema))
    return out.dropDuplicates()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents in which no benchmark item and no quotation of one is found, with their columns; one pass over them a block, no shuffle."""
    ship(docs.sparkSession)
    for index in benchmark_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            begin("decontaminate")
            index = shared.value
            for batch in freed(batches):
                for k in range(0, batch.num_rows, 512):
                    part = batch.slice(k, 512)
                    texts = part.column(part.schema.get_field_index("text")).to_pylist()
                    hit = {f[0] for f in index.finds([t or "" for t in texts])}
                    yield part.filter(pa.array([k not in hit for k in range(part.num_rows)]))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), quotations=True)
    return out.drop("row_hash")


QUERIES = {"op8_qgram_decontamination": op8_qgram_decontamination}
ORACLES: dict[str, str] = {}
