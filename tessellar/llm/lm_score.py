"""Language-model scoring by prediction by partial matching (operator 10).

The model predicts each byte of the lower-cased text from the five before it. A symbol
that a context has not seen is reached by an escape (method C) to the next shorter
context, where the symbols already ruled out are excluded, and at last by equal shares.
Every byte that a lower-cased text can hold is a symbol of its own, in whatever script, and a
text's edges are a symbol.

The trie of byte contexts, counted over all training documents, is kept in two parts.
Orders 0 to 2 are one table of at most 231^3 cells however large the corpus is: the only
thing that is broadcast, with a bound. Above that, the trie is spread by the last three
symbols of a context, so that everything below such a node meets in one task: batches
ask for the distinct predictions in their texts and get back what each one costs. Counts
of words for the base score are asked for in the same way. Nothing that grows with the
corpus is gathered in one place. What a task works out for each byte or key is made and let
go in steps of a bounded size, so that a worker holds little more than a batch and its answers.

Passes over the batches: words; cells; predictions; scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.llm.exchange import BATCH_BYTES, Batches, answer, cut, found_in, grouped, joined
from tessellar.llm.wordstream import LOWER_AZ, SPACED, Words, binaries, mix64, slices
from tessellar.llm.workspace import Workspace

FOLDS, HELD_OUT_FOLD = 7, 2
#: The edge and all bytes but the 26 capital letters, which lower-casing leaves none of.
SYMBOLS, DENSE_ORDER, SPREAD_ORDER, ORDER = 231, 2, 3, 5
#: The edge, and what stands for a capital letter: outside the alphabet, in no text.
EDGE, RARE = 0, 255
#: Bytes of text whose words or predictions are worked on at once, and predictions that are priced at once.
STEP_BYTES, STEP_KEYS = 1 << 20, 1 << 17
_DIGIT = np.uint64(8)


def fold_of(doc_id: int | None) -> int:
    """crc32 of the id as text; of an empty text for no id."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def _in_training(table: pa.Table) -> np.ndarray:
    return np.array([fold_of(i) != HELD_OUT_FOLD for i in table["doc_id"].to_pylist()], bool)


class _Tokens:
    """The words of a batch's texts: the distinct ones, sorted (``distinct``), how many each text has (``in_text``)."""

    def __init__(self, texts: list[bytes]):
        self.parts: list[tuple[int, int, np.ndarray]] = []
        found, in_text = [], [np.empty(0, np.int64)]
        for lo, hi in slices(texts, STEP_BYTES):
            words = Words(texts[lo:hi], SPACED, lower=True)
            code, own = pd.factorize(words.hashes())
            self.parts.append((lo, hi, code.astype(np.int32)))
            found.append(own)
            in_text.append(np.diff(words.first))
        self.in_text = np.concatenate(in_text)
        self.distinct = np.unique(np.concatenate([np.empty(0, np.uint64), *found]))
        self.places = [np.searchsorted(self.distinct, own) for own in found]

    def each(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """By steps: a range of texts, for each of its words the text, and the place among the distinct ones."""
        for (lo, hi, code), place in zip(self.parts, self.places, strict=True):
            yield lo, hi, np.repeat(np.arange(hi - lo), self.in_text[lo:hi]), place[code]


def _ask_words(parts: int) -> Callable[[pa.Table], pa.Table]:
    def ask(table: pa.Table) -> pa.Table:
        texts, training = binaries(table["text"]), _in_training(table)
        tokens = _Tokens(texts)
        key = tokens.distinct
        count = np.zeros(len(key), np.uint32)
        for lo, hi, text, place in tokens.each():
            at, n = np.unique(place[training[lo:hi][text]], return_counts=True)
            count[at] += n.astype(np.uint32)
        return cut(
            key,
            parts,
            table["batch"][0].as_py(),
            [("keys", lambda a, b: key[a:b].tobytes()), ("counts", lambda a, b: count[a:b].tobytes())],
        )

    return ask


def _count_words(table: pa.Table) -> pa.Table:
    """The corpus count of each key of each blob; the first row also has the range's sums."""
    keys = table["keys"].to_pylist()
    key, mine = joined(keys, np.uint64), joined(table["counts"].to_pylist(), np.uint32)
    order, begin = grouped(key)
    total = np.add.reduceat(mine[order].astype(np.int64), begin)
    back = np.empty(len(key), np.int64)
    back[order] = np.repeat(total, np.diff(np.append(begin, len(key))))
    ends = np.cumsum([len(x) // 8 for x in keys])
    blobs = [back[a:b].tobytes() for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)]
    tokens, distinct = np.zeros(len(blobs), np.int64), np.zeros(len(blobs), np.int64)
    tokens[0], distinct[0] = total.sum(), (total > 0).sum()
    return pa.Table.from_arrays(
        [table["batch"], table["part"], pa.array(blobs, pa.binary()), pa.array(tokens), pa.array(distinct)],
        names=["batch", "part", "counts", "tokens", "distinct"],
    )


def alphabet(counts: np.ndarray | None = None) -> np.ndarray:
    """The symbol of each byte, in order of bytes; the same for every corpus, so ``counts`` are not read."""
    symbol = np.full(256, RARE, np.uint32)
    own = np.unique(np.frombuffer(LOWER_AZ, np.uint8))
    symbol[own] = np.arange(1, len(own) + 1)
    return symbol


def _coded(texts: list[bytes], symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as symbols, edges between; the places that are predicted (each byte, then the
    end); and where each text's predictions begin among them."""
    joined_texts = bytes(ORDER) + b"".join(t.translate(LOWER_AZ) + bytes(ORDER) for t in texts)
    coded = symbol[np.frombuffer(joined_texts, np.uint8)]
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = ORDER + np.cumsum(sizes + ORDER) - ORDER
    predicted = np.ones(len(coded), bool)
    coded[:ORDER], predicted[:ORDER] = EDGE, False
    for j in range(ORDER):
        coded[ends + j] = EDGE
        if j:
            predicted[ends + j] = False
    return coded, np.flatnonzero(predicted), np.concatenate([[0], np.cumsum(sizes + 1)])


def _cells(coded: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The cell of each prediction in the table of orders 0 to 2."""
    cell = np.zeros(len(coded) - DENSE_ORDER, np.uint32)
    for j in range(DENSE_ORDER + 1):
        cell = cell * np.uint32(SYMBOLS) + coded[j : len(coded) - DENSE_ORDER + j]
    return cell[place - DENSE_ORDER]


def _predictions(coded: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A key for each prediction: 16 bits of hash of the last three symbols, then the context
    backwards and the symbol, 8 bits each. Sorted keys have each context's together, at every order."""
    n = len(coded) - ORDER
    key = np.zeros(n, np.uint64)
    for j in range(1, ORDER + 1):
        key <<= _DIGIT
        key |= coded[ORDER - j : ORDER - j + n]
    near = mix64(key >> np.uint64(8 * (ORDER - SPREAD_ORDER)))
    near >>= np.uint64(48)
    near <<= np.uint64(48)
    key <<= _DIGIT
    key |= coded[ORDER:]
    key |= near
    return key[place - ORDER]


def _count_cells(symbol: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    size = SYMBOLS ** (DENSE_ORDER + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        for batch in batches:
            texts = [t for t, use in zip(binaries(batch["text"]), _in_training(batch), strict=True) if use]
            for lo, hi in slices(texts, STEP_BYTES):
                np.add.at(total, _cells(*_coded(texts[lo:hi], symbol)[:2]), np.uint32(1))
        used = np.flatnonzero(total)
        for lo in range(0, len(used), 1 << 16):
            part = used[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(total[part], pa.int64())], names=["cell", "n"]
            )

    return count


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sum of each one's counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order, begin = grouped(key)
    total = np.add.reduceat(count[order], begin, dtype=np.uint32) if len(begin) else count
    return key[order[begin]], total


def _ask_predictions(parts: int, symbol: np.ndarray) -> Callable[[pa.Table], pa.Table]:
    def ask(table: pa.Table) -> pa.Table:
        texts, training = binaries(table["text"]), _in_training(table)
        key, count, keys, counts, waiting = np.empty(0, np.uint64), np.empty(0, np.uint32), [], [], 0
        for lo, hi in slices(texts, STEP_BYTES):
            coded, place, begin = _coded(texts[lo:hi], symbol)
            code, distinct = pd.factorize(_predictions(coded, place))
            keys.append(distinct)
            counts.append(np.bincount(code[np.repeat(training[lo:hi], np.diff(begin))], minlength=len(distinct)).astype(np.uint32))
            waiting += len(distinct)
            # the distinct keys of some steps are merged as soon as they are as many as those of all steps before
            if waiting >= max(len(key), 2 * STEP_KEYS) or hi == len(texts):
                key, count = _merged([key, *keys], [count, *counts])
                keys, counts, waiting = [], [], 0
        return cut(
            key,
            parts,
            table["batch"][0].as_py(),
            [("keys", lambda a, b: key[a:b].tobytes()), ("counts", lambda a, b: count[a:b].tobytes())],
        )

    return ask


def _groups(sorted_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted values: where each distinct one begins, and which of them each is."""
    new = np.ones(len(sorted_key), bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _escape(total: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """The share of what a context has not seen; all of it, where nothing is left in the context."""
    return np.where(total > 0, distinct / np.maximum(total + distinct, 1), 1.0)


def costs(key: np.ndarray, n: np.ndarray, model: PartialMatching) -> np.ndarray:
    """log10 of the probability of each prediction.

    ``key``: sorted and distinct, all that begin with their last three symbols; ``n``: how
    often each occurs in training; ``model``: the table of orders 0 to 2. Those of the same
    last three symbols are priced together, and as many of them at once as are in a step.
    """
    out = np.empty(len(key), np.float32)
    near = key >> np.uint64(8 * (ORDER + 1 - SPREAD_ORDER))
    lo = 0
    while lo < len(key):
        hi = len(key)
        if hi - lo > STEP_KEYS:
            # up to the last key before which three other symbols end; if one node fills the step, to the node's end
            hi = int(np.searchsorted(near, near[lo + STEP_KEYS]))
            if hi <= lo:
                hi = int(np.searchsorted(near, near[lo], "right"))
        out[lo:hi] = _costs(key[lo:hi], n[lo:hi], model)
        lo = hi
    return out


def _costs(key: np.ndarray, n: np.ndarray, model: PartialMatching) -> np.ndarray:
    sym = key & np.uint64(255)
    n = n.astype(np.float64)
    # contexts of 5, 4 and 3 symbols (5 first); for each, its counts, and its predictions' counts
    context = [key >> np.uint64(8 * (1 + drop)) for drop in range(ORDER - SPREAD_ORDER + 1)]
    count, total, distinct = [n], [], []
    for drop, c in enumerate(context):
        if drop:
            # the same symbol after all longer contexts: a stable order by (shorter context, symbol)
            order = np.lexsort((sym, c))
            same = np.empty(len(key), np.int64)
            _, label = _groups(c[order] << _DIGIT | sym[order])
            same[order] = label
            count.append(np.bincount(same, n)[same])
            once = np.zeros(len(key), bool)
            once[order[_groups(label)[0]]] = True
        else:
            once = np.ones(len(key), bool)
        begin, which = _groups(c)
        total.append(np.add.reduceat(n, begin)[which])
        distinct.append(np.add.reduceat((once & (count[drop] > 0)).astype(np.float64), begin)[which])
    # the context of two symbols has its counts in the table
    near = context[-1]
    two = [((near >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64) for k in range(SPREAD_ORDER - DENSE_ORDER, SPREAD_ORDER)]
    node = two[0] * SYMBOLS + two[1]
    cell = node * SYMBOLS + sym.astype(np.int64)
    seen, totals, kinds = model.seen(cell)
    context.append(near >> _DIGIT)
    count.append(seen)
    total.append(totals)
    distinct.append(kinds)
    left, cost, open_ = np.ones(len(key)), np.zeros(len(key)), np.ones(len(key), bool)
    for drop, c in enumerate(context):
        t, d = total[drop], distinct[drop]
        if drop:  # without the symbols that the longer context had
            longer = context[drop - 1]
            order = np.lexsort((sym, longer))
            begin, which = _groups(longer[order])
            first = np.zeros(len(key), bool)
            first[order[_groups(longer[order] << _DIGIT | sym[order])[0]]] = True
            had = np.where(first & (count[drop - 1] > 0), count[drop], 0.0)
            gone = np.empty(len(key))
            gone[order] = np.add.reduceat(had[order], begin)[which]
            t, d = t - gone, d - distinct[drop - 1]
        found = open_ & (count[drop] > 0)
        cost[found] = np.log10(left[found] * count[drop][found] / (t + d)[found])
        open_ &= ~found
        left = left * _escape(t, d)
    # the table's share of an unseen symbol holds the escape from the whole context of two
    cost[open_] = np.log10(left[open_] / _escape(total[-1], distinct[-1])[open_]) + model.share(cell[open_])
    return cost.astype(np.float32)


def _answer_predictions(model) -> Callable[[pa.Table], pa.Table]:
    def reply(table: pa.Table) -> pa.Table:
        keys = table["keys"].to_pylist()
        key, mine = joined(keys, np.uint64), joined(table["counts"].to_pylist(), np.uint32)
        order, begin = grouped(key)
        cost = costs(key[order][begin], np.add.reduceat(mine[order].astype(np.int64), begin), model.value)
        back = np.empty(len(key), np.float32)
        back[order] = np.repeat(cost, np.diff(np.append(begin, len(key))))
        ends = np.cumsum([len(x) // 8 for x in keys])
        blobs = [back[a:b].tobytes() for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)]
        return pa.Table.from_arrays(
            [table["batch"], table["part"], table["keys"], pa.array(blobs, pa.binary())], names=["batch", "part", "keys", "costs"]
        )

    return reply


class PartialMatching:
    """Orders 0 to 2, from the counts of all cells that are seen."""

    def __init__(self, cell: np.ndarray, n: np.ndarray):
        order = np.argsort(cell)
        self.cell, self.n, self._sums = cell[order], n[order], None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_sums": None}

    def _made(self) -> tuple[np.ndarray, ...]:
        """Of contexts of two, one and no symbols the sums and numbers of symbols seen, without those that longer
        contexts had; at most 231^2 of each, made once in each process that needs them."""
        if self._sums is None:
            s = SYMBOLS
            cell, n = self.cell.astype(np.int64), self.n.astype(np.float64)
            node, after = cell // s, cell % (s * s)
            one = np.bincount(after, n, s * s)
            none = one.reshape(s, s).sum(0)
            two = [np.bincount(node, x, s * s) for x in (n, np.ones(len(n)))]
            per = [np.tile(x.reshape(s, s).sum(1), s) for x in (one, one > 0)]
            # of each context of two: what the context of one has seen and it has not
            fewer = [x - np.bincount(node, y, s * s) for x, y in zip(per, (one[after], np.ones(len(n))), strict=True)]
            # of each context of one: what is seen at all and not there
            rest = [(x * (one.reshape(s, s) == 0)).sum(1) for x in (none, (none > 0).astype(np.float64))]
            self._sums = *two, *fewer, *rest, one, none
        return self._sums

    def _counts(self, cell: np.ndarray) -> np.ndarray:
        found, at = found_in(cell, self.cell)
        count = np.zeros(len(cell))
        count[found] = self.n[at[found]]
        return count

    def seen(self, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The count of each cell; the sum and the number of symbols seen of its context of two."""
        total, distinct = self._made()[:2]
        return self._counts(cell), total[cell // SYMBOLS], distinct[cell // SYMBOLS]

    def share(self, cell: np.ndarray) -> np.ndarray:
        """log10 of the probability of each cell's symbol, in single precision."""
        s = SYMBOLS
        total2, kinds2, total1, kinds1, total0, kinds0, one, none = self._made()
        node, last = cell // s, cell // s % s
        left, share, open_ = np.ones(len(cell)), np.zeros(len(cell)), np.ones(len(cell), bool)
        for count, total, distinct in (
            (self._counts(cell), total2[node], kinds2[node]),
            (one[cell % (s * s)], total1[node], kinds1[node]),
            (none[cell % s], total0[last], kinds0[last]),
        ):
            share += left * np.where(open_, count, 0.0) / np.maximum(total + distinct, 1)
            left = left * _escape(total, distinct)
            open_ &= count == 0
        share += left * open_ / max(int((none == 0).sum()), 1)
        return np.log10(share).astype(np.float32)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _told(table: pa.Table, column: str, kind) -> np.ndarray:
    """A column of all ranges' answers, in their order."""
    rows = sorted((p, x) for p, x in zip(table["part"].to_pylist(), table[column].to_pylist(), strict=True) if x is not None)
    return joined([x for _, x in rows], kind)


def _score(symbol: np.ndarray, tokens: int, distinct: int, ends: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def score(table: pa.Table, told: pa.Table) -> pa.Table:
        texts, training = binaries(table["text"]), _in_training(table)
        own = _Tokens(texts)
        counts = _told(told, "word_counts", np.int64)
        size = tokens + distinct + 1
        base, known = np.full(len(texts), np.log10((ends + 1) / size)), np.full(len(texts), int(ends > 0))
        for lo, hi, text, place in own.each():
            count = counts[place]
            base[lo:hi] += np.bincount(text, np.log10((count + 1) / size), hi - lo)
            known[lo:hi] += np.bincount(text, count > 0, hi - lo).astype(np.int64)
        n_words = own.in_text
        del own, counts
        key, cost = pd.Index(_told(told, "keys", np.uint64)), _told(told, "costs", np.float32)
        scores = [np.empty(0)]
        for lo, hi in slices(texts, STEP_BYTES):
            coded, place, begin = _coded(texts[lo:hi], symbol)
            each = cost[key.get_indexer(_predictions(coded, place))].astype(np.float64)
            scores.append(np.add.reduceat(each, begin[:-1]))
        return pa.Table.from_arrays(
            [
                table["doc_id"],
                pa.array(~training),
                pa.array(n_words + 1, pa.int64()),
                pa.array(known, pa.int64()),
                pa.array(np.full(len(texts), tokens), pa.int64()),
                pa.array(base, pa.float64()),
                pa.array(np.concatenate(scores), pa.float64()),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return score


def lm_scores(docs: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Score every document with a model of those outside the held-out fold.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Defined cases: a null text is an empty one, of which only the end is predicted; a row
    without id is in training; repeated rows are learned and scored each; without any
    training document all symbols have equal shares; an empty table gives an empty
    result; other columns are not read.
    """
    spark = docs.sparkSession
    batches = Batches(docs, ws, id_col, text_col, batch_bytes)
    words = batches.ask(_ask_words(batches.parts), "part long, batch long, keys binary, counts binary")
    told = ws.write(answer(words, batches.parts, _count_words, "batch long, part long, counts binary, tokens long, distinct long"), "told")
    sums = told.agg(F.sum("tokens"), F.sum("distinct")).first()
    texts = batches.table.select("doc_id", "text")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    ends = texts.where(fold != HELD_OUT_FOLD).count()
    symbol = alphabet()
    # at most 231^3 rows, whatever the corpus
    cells = texts.mapInArrow(_count_cells(symbol), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    model = spark.sparkContext.broadcast(PartialMatching(cells["cell"].to_numpy(), cells["n"].to_numpy()))
    asked = batches.ask(_ask_predictions(batches.parts, symbol), "part long, batch long, keys binary, counts binary")
    priced = ws.write(answer(asked, batches.parts, _answer_predictions(model), "batch long, part long, keys binary, costs binary"), "priced")
    tokens, distinct = (sums[0] or 0) + ends, (sums[1] or 0) + (ends > 0)
    answers = told.select("batch", "part", F.col("counts").alias("word_counts")).unionByName(priced, allowMissingColumns=True)
    result = ws.write(batches.ask(_score(symbol, tokens, distinct, ends), SCORES, answers), "result")
    ws.keep_only("result")
    return result


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, learned from those outside fold 2 of 7."""
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "op10"))
