r"""Benchmark decontamination by templates.

Texts become templates: numbers, names (capitalised words that don't begin a
sentence) and units (after a number) are replaced by typed placeholders, other
words by their lower-case form. Windows of ``WINDOW`` template tokens of the
benchmark are put in a hash table, and each document's windows are joined
with it. Where windows of an item lie on one diagonal (the same distance
between places in document and item), their slots must be consistent: one value
of the item always stands for one value of the document. Windows that touch a
value for which this doesn't hold don't count; the others do. Capitals tell names only
where case means something, so texts and items are also matched in a second
form, in which names are words like others: copies in upper case, title case
or lower case are found by it. A document holds an
item if consistent windows cover at least ``COVERAGE`` of the item's windows,
whether its values are the item's own or others; it is re-parameterised if a
value in a window that counts isn't the item's own.

The table is broadcast in blocks of at most ``BLOCK_BYTES`` bytes of benchmark
texts, so its size has a bound; a larger benchmark takes more passes over the
documents. What a document holds depends on it alone: no shuffle, and no
common passage gathers rows in a task.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.llm.common import bound_batches, table

WINDOW = 5
COVERAGE = 0.5
#: Words that aren't placeholders which a window needs, to say more than a form.
LITERALS = 2
BLOCK_BYTES = 16 << 20
#: Tokens whose canonical form a worker remembers at most; the memory is then emptied.
REMEMBERED = 100_000
BITMAP_BITS = 22

#: Units (fixed values).
UNITS = frozenset(
    "mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t lb lbs oz ounce ounces pound pounds gram grams kilogram kilograms ton tons ml cl l liter liters litre litres gallon gallons "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "percent dollar dollars euro euros cent cents usd eur gbp kb mb gb tb hz khz mhz ghz w kw mw v kv j kj cal kcal k c f mph kmh degree degrees".split()
)
UPPER = "A-ZÀ-ÖØ-ÞΑ-ΡΣ-ΫА-ЯЁ"
#: A capital after a word, comma, semicolon or colon and a space, so not at a sentence's beginning.
NAME = re.compile(rf"(?<=[\w,;:] )[{UPPER}]")
TOKEN = re.compile(r"\x02?[^\W\d_]+|\d+(?:[.,]\d+)*")
#: Four letters of a script that is written without spaces.
UNSPACED = re.compile("[\u0e00-\u0eff\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003ffff]{4}")
#: Tokens by which items without a telling window are looked up.
LEADING = 3
OTHER, NUMBER, NAMED, UNIT = 0, 1, 2, 3
FIRST_WORD = 4


def tokens(text: str | None) -> list[str]:
    """Words and numbers as they are written; names begin with a mark."""
    return TOKEN.findall(NAME.sub("\x02\\g<0>", (text or "").replace("\x02", " ")))


def plain(token: str) -> str:
    return token.lstrip("\x02").lower()


def nameless(written: list[str]) -> list[str]:
    """The tokens with names as words like others."""
    return [t.lstrip("\x02") for t in written]


def says_enough(written: list[str]) -> bool:
    """Whether an item may be looked for inside texts: not one or two words, but where scripts have no spaces a token is a clause."""
    return len(written) > 2 or any(UNSPACED.search(t) for t in written)


class Canonical(dict):
    """Ids of tokens as they are written, without regard to their places: a memory that fills itself."""

    def __init__(self, words: dict[str, int]):
        super().__init__()
        self.words = words

    def __missing__(self, token: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        if token[0] == "\x02":
            found = NAMED
        elif token[0].isdigit():
            found = NUMBER
        else:
            found = self.words.get(token.lower(), OTHER)
        self[token] = found
        return found


def template(ids: np.ndarray, is_unit: np.ndarray) -> np.ndarray:
    """Units after numbers become placeholders."""
    out = ids.copy()
    if len(ids) > 1:
        after = (ids[:-1] == NUMBER) & is_unit[ids[1:]]
        out[1:][after] = UNIT
    return out


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    if len(ids) < width:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(ids) - width + 1, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - width + 1 + k].astype(np.uint64)
        h ^= h >> np.uint64(29)
    return h


def telling(ids: np.ndarray, width: int) -> np.ndarray:
    """Whether each window has enough words that aren't placeholders."""
    literal = np.concatenate(([0], np.cumsum(ids >= FIRST_WORD)))
    return literal[width:] - literal[:-width] >= min(LITERALS, width)


@dataclass
class Block:
    """A hash table of template windows."""

    words: dict[str, int]
    is_unit: np.ndarray
    item_ids: list
    templates: list[np.ndarray]
    values: list[list[str]]  # tokens as written
    n_windows: np.ndarray
    hashes: np.ndarray  # sorted; an entry for each window of each item
    items: np.ndarray
    places: np.ndarray
    bitmap: np.ndarray
    width: int
    whole: dict[tuple[int, ...], list[int]]  # items that are shorter than a window
    owners: np.ndarray  # the row of each item; one with names is there in two forms
    exact: dict[tuple[str, ...], list[tuple[tuple[str, ...], int]]]  # items without a telling window, as written, by their first tokens

    @classmethod
    def build(cls, rows: list[tuple[object, str | None]], width: int = WINDOW) -> Block:
        written = [tokens(t) for _, t in rows]
        owners = list(range(len(rows)))
        for i in range(len(rows)):
            if any(t[0] == "\x02" for t in written[i]):
                written.append(nameless(written[i]))
                owners.append(i)
        words: dict[str, int] = {}
        for w in sorted(UNITS):
            words[w] = FIRST_WORD + len(words)
        for toks in written:
            for t in toks:
                if t[0] != "\x02" and not t[0].isdigit():
                    words.setdefault(t.lower(), FIRST_WORD + len(words))
        is_unit = np.zeros(FIRST_WORD + len(words), bool)
        is_unit[[words[w] for w in UNITS]] = True
        canonical = Canonical(words)
        templates = [template(np.array([canonical[t] for t in toks], np.int64), is_unit) for toks in written]
        hashes, items, places, whole = [], [], [], defaultdict(list)
        n_windows = np.zeros(len(owners), np.int64)
        for i, ids in enumerate(templates):
            if 0 < len(ids) < width:
                whole[tuple(ids.tolist())].append(i)
                continue
            at = np.flatnonzero(telling(ids, width)) if len(ids) >= width else np.zeros(0, np.int64)
            n_windows[i] = len(at)
            hashes.append(window_hashes(ids, width)[at])
            items.append(np.full(len(at), i))
            places.append(at)
        exact = defaultdict(list)
        telling_rows = {o for o, n in zip(owners, n_windows.tolist(), strict=True) if n}
        for i, toks in enumerate(written[: len(rows)]):
            if i not in telling_rows and says_enough(toks):
                own = tuple(map(plain, toks))
                exact[own[:LEADING]].append((own, i))
        none = [np.zeros(0, np.int64)]
        all_hashes = np.concatenate(hashes or [np.zeros(0, np.uint64)])
        order = np.argsort(all_hashes, kind="stable")
        bitmap = np.zeros(1 << BITMAP_BITS, bool)
        bitmap[(all_hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)] = True
        return cls(words, is_unit, [rows[o][0] for o in owners], templates, written, n_windows, all_hashes[order], np.concatenate(items or none)[order], np.concatenate(places or none)[order], bitmap, width, dict(whole), np.array(owners, np.int64), dict(exact))

    def matches(self, text: str | None, canonical: Canonical, coverage: float = COVERAGE) -> list[tuple]:
        """(item_id, windows matched, windows of the item, whether a value differs) for each item that the text holds."""
        written = tokens(text)
        ids = np.fromiter(map(canonical.__getitem__, written), np.int64, len(written))
        found = self._matches(written, template(ids, self.is_unit), coverage)
        if self.exact:
            found += self._exact(written)
        named = np.flatnonzero(ids == NAMED)
        if len(named):
            for at in named.tolist():
                written[at] = written[at][1:]
                ids[at] = canonical[written[at]]
            found += self._matches(written, template(ids, self.is_unit), coverage)
        # Of an item's forms the one that is covered best, and of these one without other values.
        best: dict[int, tuple] = {}
        for i, matched, windows, changed in found:
            row = int(self.owners[i])
            if row not in best or (matched * best[row][2], best[row][3]) > (best[row][1] * windows, changed):
                best[row] = (self.item_ids[i], matched, windows, changed)
        return list(best.values())

    def _exact(self, written: list[str]) -> list[tuple]:
        """Items without a telling window whose tokens follow each other in the text just as they are."""
        own = tuple(map(plain, written))
        found = set()
        for length in {len(k) for k in self.exact}:
            for at in range(len(own) - length + 1):
                for sequence, i in self.exact.get(own[at : at + length], ()):
                    if own[at : at + len(sequence)] == sequence:
                        found.add(i)
        return [(i, 1, 1, False) for i in sorted(found)]

    def _matches(self, written: list[str], ids: np.ndarray, coverage: float) -> list[tuple]:
        """``matches`` of one form of a text, with the number of each item's form in place of its id."""
        if len(ids) < self.width:
            found = self.whole.get(tuple(ids.tolist()), []) if (ids >= FIRST_WORD).any() else []
            same = [plain(w) for w in written]
            return [(i, 1, 1, same != [plain(w) for w in self.values[i]]) for i in found]
        hashes = window_hashes(ids, self.width)
        at = np.flatnonzero(self.bitmap[(hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)])
        at = at[telling(ids, self.width)[at]]
        low, high = (np.searchsorted(self.hashes, hashes[at], side) for side in ("left", "right"))
        counts = high - low
        if not counts.sum():
            return []
        doc_at = np.repeat(at, counts)
        entry = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
        items, places = self.items[entry], self.places[entry]
        # Only items that could be covered enough are looked at closely.
        seen = np.bincount(items, minlength=len(self.n_windows))
        hopeful = seen[items] >= coverage * self.n_windows[items]
        out = []
        groups: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, p, d in zip(items[hopeful].tolist(), places[hopeful].tolist(), doc_at[hopeful].tolist(), strict=True):
            groups[i][d - p].append(p)
        for i, diagonals in groups.items():
            covered, changed = set(), False
            for shift, starts in diagonals.items():
                clear, differs = self._slots(i, shift, starts, ids, written)
                covered.update(clear)
                changed |= differs
            if len(covered) >= coverage * self.n_windows[i]:
                out.append((i, len(covered), int(self.n_windows[i]), changed))
        return out

    def _slots(self, item: int, shift: int, starts: list[int], ids: np.ndarray, written: list[str]) -> tuple[list[int], bool]:
        """The windows of a diagonal that touch no conflicting slot, and whether a value in them differs from the item's.

        A slot conflicts if a value of the item stands for several values on
        the diagonal, or if the templates differ there.
        """
        own, known, conflicts, differing = self.templates[item], {}, set(), set()
        places = {p + k for p in starts for k in range(self.width)}
        slot = {}
        for p in places:
            kind = own[p]
            if ids[p + shift] != kind:
                slot[p] = p
                conflicts.add(p)
            elif kind < FIRST_WORD:
                a, b = plain(self.values[item][p]), plain(written[p + shift])
                slot[p] = (kind, a)
                if known.setdefault((kind, a), b) != b:
                    conflicts.add((kind, a))
                if a != b:
                    differing.add(p)
        blocked = {p for p, s in slot.items() if s in conflicts}
        clear = [p for p in starts if not any(p + k in blocked for k in range(self.width))]
        return clear, any(p + k in differing for p in clear for k in range(self.width))


MATCH = "array<struct<item: {}, matched: int, windows: int, reparameterised: boolean>>"


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The benchmark's items in blocks of about ``block_bytes``, each read only when it is needed."""
    rows = benchmark.filter(F.col(text).isNotNull()).select(F.col(item).alias("item"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    part = F.pmod(F.xxhash64("item", "text"), F.lit(max(1, n)))
    for k in range(n):
        yield Block.build([(r.item, r.text) for r in rows.filter(part == k).orderBy("item", "text").collect()])


def matches(spark: SparkSession, block: Block, text: Column, item_type: str = "bigint", coverage: float = COVERAGE) -> Column:
    """The items of a block that each text holds. A null or empty text holds none."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(block)

    @F.pandas_udf(MATCH.format(item_type))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        canonical = Canonical(shared.value.words)
        for texts in batches:
            yield pd.Series([[{"item": a, "matched": b, "windows": c, "reparameterised": bool(d)} for a, b, c, d in shared.value.matches(x if isinstance(x, str) else None, canonical, coverage)] for x in texts])

    return run(text)


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, matched_windows, item_windows, reparameterised): a row for each item that a row of ``docs`` holds.

    Null ids, ties and repeated rows of either table are kept as they are;
    other columns are left out. An item without a telling window, or shorter
    than one, is held by texts that have its tokens in a row as they are; one
    or two words of a script with spaces say too little for that. One shorter
    than a window also matches texts that are just its template.
    """
    kind = benchmark.schema["item_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    out = None
    for block in blocks(benchmark):
        found = rows.select("doc_id", F.explode(matches(spark, block, F.col("text"), kind, coverage)).alias("_m"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.limit(0).select("doc_id", F.explode(F.array().cast(MATCH.format(kind))).alias("_m"))
    return out.select("doc_id", F.col("_m.item").alias("item_id"), F.col("_m.matched").alias("matched_windows"), F.col("_m.windows").alias("item_windows"), F.col("_m.reparameterised").alias("reparameterised"))


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in documents; documents that hold none have no row."""
    return contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go."""
    benchmark = table(spark, sf_dir, "benchmark")
    kind = benchmark.schema["item_id"].dataType.simpleString()
    for block in blocks(benchmark):
        docs = docs.filter(F.size(matches(spark, block, F.col("text"), kind)) == 0)
    return docs
