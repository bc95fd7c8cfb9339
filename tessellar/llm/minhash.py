"""Near-duplicate detection by an inverted join of MinHash signature coordinates (operator 6).

1. Shingles. A document's set is its distinct 5-word shingles. Documents with equal sets
   are one class; from here on only classes count, however many copies they have.
2. Postings. A class is posted under each (coordinate, value) of its signature of 64.
   Two classes can be similar only if they collide on at least 32 coordinates, so they
   share one of the 33 rarest postings of either (prefix filter); postings that nobody
   else has, and classes left with fewer than 32, fall out at once.
3. Merging. In each list every class is paired with the list's most central class, the one
   whose postings are the most shared; of its pairs, each class has the one with the most
   collisions confirmed on the full sets. Lists whose classes are all in one component by
   then are skipped. In the others, pairs of different components with enough collisions
   are confirmed, the best of each first, until no list has an untried one. So a group of
   thousands of near copies costs about a pair for each member, and no pair of different
   components goes untried.

Collisions of pairs are counted on a longer sketch (1024 coordinates, a byte of each),
made for the classes that are left. Two documents at the threshold of 0.75 collide on 48
of 64 and 768 of 1024 coordinates on average; they have fewer than 32 about once in
200,000 such pairs, and fewer than 704 about as rarely.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.llm.bitmap import bitmap_of, bits_for, has
from tessellar.llm.components import components
from tessellar.llm.wordstream import U64, Words, binaries, mix64, run_hashes, runs_inside, slices
from tessellar.llm.workspace import Workspace

SHINGLE, COORDINATES, MATCHES = 5, 64, 32
SKETCH, SKETCH_MATCHES = 1024, 704
#: The part of a sketch that is compared first, and the fewest collisions there.
GLANCE, GLANCE_MATCHES = 256, 150
#: Linked if PERCENT[0] * intersection >= PERCENT[1] * union.
PERCENT = (100, 75)
#: Bytes of text that are worked on at once, and classes of a list that are compared in one task.
STEP_BYTES, LIST_BLOCK = 1 << 20, 1024

_random = np.random.Generator(np.random.PCG64(66))
_TURN = _random.integers(0, 1 << 64, SKETCH, dtype=U64)
_FACTOR = _random.integers(0, 1 << 63, SKETCH, dtype=U64) * U64(2) + U64(1)

SIGNED = "doc_id long, n_shingles long, cls binary, slot long, signature array<int>"


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, one after the other, and where each text's begin."""
    words = Words(texts, lower=True)
    hashed, first = words.hashes(), words.first
    doc_of = words.text_of_word()
    size = np.diff(first)
    inside = np.flatnonzero(runs_inside(first, shingle))
    keys, docs = [run_hashes(hashed, shingle)[inside]], [doc_of[inside]]
    for n in range(1, shingle):
        short = np.flatnonzero(size == n)
        if len(short):
            keys.append(run_hashes(hashed, n)[first[short]])
            docs.append(short)
    key, doc = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[new], doc[new]
    return key, np.searchsorted(doc, np.arange(len(texts) + 1))


def class_ids(key: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """128 bits for each set, equal for equal sets."""
    sums = [np.concatenate([np.zeros(1, U64), np.cumsum(mix64(key ^ U64(salt)))]) for salt in (0x1234567, 0x89ABCDEF01)]
    halves = np.stack([mix64(s[begin[1:]] - s[begin[:-1]] + np.diff(begin).astype(U64)) for s in sums], 1)
    raw = np.ascontiguousarray(halves).tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


def slots(ids: list[bytes]) -> np.ndarray:
    """A number from 0 for each class; its remainder is the class's bit in a bitmap."""
    return (np.frombuffer(b"".join(ids), U64)[::2] >> U64(1)).astype(np.int64)


def signatures(key: np.ndarray, begin: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """A row of coordinates for each set (zeros for an empty one)."""
    out = np.zeros((len(begin) - 1, coordinates), np.int32)
    full = np.flatnonzero(np.diff(begin))
    if len(full):
        for k in range(coordinates):
            least = np.minimum.reduceat((key ^ _TURN[k]) * _FACTOR[k], begin[full])
            out[full, k] = (mix64(least) >> U64(32)).astype(np.uint32).view(np.int32)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = binaries(batch["text"])
        for lo, hi in slices(texts, STEP_BYTES):
            key, begin = shingle_sets(texts[lo:hi])
            ids = class_ids(key, begin)
            signature = pa.FixedSizeListArray.from_arrays(pa.array(signatures(key, begin).ravel()), COORDINATES)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].slice(lo, hi - lo),
                    pa.array(np.diff(begin), pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(slots(ids)),
                    signature.cast(pa.list_(pa.int32())),
                ],
                names=["doc_id", "n_shingles", "cls", "slot", "signature"],
            )


def _texts_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``cls, sketch, text`` and the other columns of each class, found by one more pass over the documents."""
    size = bits_for(classes.count())
    marked = bitmap_of(classes.select((F.pmod("slot", F.lit(size)) + 1).alias("slot")), size)
    wanted = docs.sparkSession.sparkContext.broadcast(marked)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binaries(batch["text"])
            for lo, hi in slices(texts, STEP_BYTES):
                key, begin = shingle_sets(texts[lo:hi])
                ids = class_ids(key, begin)
                # of equal sets here, the first
                pick = list({ids[i]: i for i in np.flatnonzero(has(wanted.value, slots(ids) % size + 1))[::-1].tolist()}.values())
                own = [key[begin[i] : begin[i + 1]] for i in pick]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
                sketch = signatures(np.concatenate([*own, np.empty(0, U64)]), bounds, SKETCH).astype(np.uint8)
                columns = ([ids[i] for i in pick], [x.tobytes() for x in sketch], [texts[lo + i] for i in pick])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=["cls", "sketch", "text"])

    found = docs.select("text").mapInArrow(keep, "cls binary, sketch binary, text binary")
    one = found.groupBy("cls").agg(F.first("sketch").alias("sketch"), F.first("text").alias("text"))
    return one.join(classes.drop("slot").hint("merge"), "cls")


def _sketches(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH)


def _posted(prefixes: pa.ChunkedArray) -> np.ndarray:
    """The value each class is posted with, by coordinate; where it is not, a number of its own."""
    lists = prefixes.to_pylist()
    out = np.repeat(-1 - np.arange(len(lists)), COORDINATES).reshape(len(lists), COORDINATES)
    for row, tokens in zip(out, lists, strict=True):
        token = np.array(tokens, np.int64)
        row[token >> 32] = token & 0xFFFFFFFF
    return out


def _count_collisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = (_sketches(batch["sa"]) == _sketches(batch["sb"])).sum(1)
        ok = pa.array(near >= SKETCH_MATCHES)
        out = pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(near, pa.int64())], names=["a", "b", "matches"])
        yield out.filter(ok)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both texts, those whose full sets are similar enough."""
    for batch in batches:
        left, right = batch["text_a"].to_pylist(), batch["text_b"].to_pylist()
        keep = np.zeros(len(left), bool)
        for lo, hi in slices([a + b for a, b in zip(left, right, strict=True)], STEP_BYTES):
            key, begin = shingle_sets(left[lo:hi] + right[lo:hi])
            n = hi - lo
            for i in range(n):
                a, b = key[begin[i] : begin[i + 1]], key[begin[n + i] : begin[n + i + 1]]
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep[lo + i] = both > 0 and PERCENT[0] * both >= PERCENT[1] * (len(a) + len(b) - both)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


class _Linker:
    """The classes with candidates: their signatures, postings, texts, tried pairs and links so far."""

    def __init__(self, classes: DataFrame, docs: DataFrame, ws: Workspace):
        self.ws, self.round = ws, 0
        token = F.shiftleft(F.col("pos").cast("long"), 32) + F.col("col").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
        tokens = classes.select("cls", F.posexplode("signature")).select("cls", token.alias("token"))
        shared = ws.write(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared")
        prefix = COORDINATES - MATCHES + 1
        # postings with one class come first in every prefix, though they are gone
        length = F.lit(prefix - COORDINATES) + F.size("held")
        chosen = (
            tokens.join(shared.hint("merge"), "token")
            .groupBy("cls")
            .agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("held"), F.sum("df").alias("weight"))
            .where((F.size("held") >= MATCHES) & (length > 0))
            .select("cls", "weight", F.slice("held", 1, length)["token"].alias("prefix"))
        )
        chosen = ws.write(chosen.join(classes.select("cls", "slot").hint("merge"), "cls"), "chosen")
        self.postings = ws.write(chosen.select("cls", "weight", F.explode("prefix").alias("token")), "postings")
        self.texts = ws.write(_texts_of(docs, chosen.select("cls", "slot", "prefix")), "texts")
        self.tried: DataFrame | None = None
        self.links: list[DataFrame] = []

    def matches(self, pairs: DataFrame) -> DataFrame:
        """``a, b, matches`` for those of distinct pairs with enough collisions."""
        side = self.texts.select("cls", "sketch")
        both = pairs.join(side.select(F.col("cls").alias("a"), F.col("sketch").alias("sa")).hint("merge"), "a").join(
            side.select(F.col("cls").alias("b"), F.col("sketch").alias("sb")).hint("merge"), "b"
        )
        return both.mapInArrow(_count_collisions, "a binary, b binary, matches long")

    def confirm(self, pairs: DataFrame) -> int:
        """Try new pairs (a < b) on the full sets and keep the links; how many were tried."""
        self.round += 1
        if self.tried is not None:
            pairs = pairs.join(self.tried.hint("merge"), ["a", "b"], "left_anti")
        pairs = self.ws.write(pairs, f"pairs{self.round}")
        n = pairs.count()
        if n:
            self.tried = pairs if self.tried is None else self.tried.unionByName(pairs)
            texts = self.texts
            both = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a").join(
                texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b"
            )
            self.links.append(self.ws.write(both.mapInArrow(_confirm, "a binary, b binary"), f"links{self.round}"))
        return n

    def all_links(self) -> DataFrame | None:
        out = None
        for links in self.links:
            out = links if out is None else out.unionByName(links)
        return out

    def stars(self) -> DataFrame:
        """Each class with the most central class of one of its lists: the one it collides with most."""
        central = self.postings.groupBy("token").agg(F.max(F.struct("weight", "cls")).alias("m")).select("token", F.col("m.cls").alias("a"))
        central = self.ws.write(central, "central")
        pairs = self.postings.join(central.hint("merge"), "token").where("a <> cls").select("a", F.col("cls").alias("b")).distinct()
        best = self.matches(pairs).groupBy("b").agg(F.max(F.struct("matches", "a")).alias("m"))
        return best.select("m.a", "b")

    def across(self, roots: DataFrame | None, most: int) -> tuple[DataFrame, bool]:
        """Pairs of different components in one list, at most ``most`` for a class and component in
        each block; whether there were more."""
        held = self.postings
        if roots is None:
            held = held.withColumn("root", F.col("cls"))
        else:
            named = roots.select(F.col("u").alias("cls"), "root")
            held = held.join(named.hint("merge"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        held = self.ws.write(held, f"held{self.round}")
        mixed = held.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y")
        blocks = F.ceil(F.col("n") / F.lit(LIST_BLOCK)).cast("int")
        rows = (
            held.join(mixed.select("token", "n").hint("merge"), "token")
            .join(self.texts.select("cls", "sketch", "prefix").hint("merge"), "cls")
            .select("token", "cls", "root", "sketch", "prefix", blocks.alias("k"))
            .withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("k")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
            .select("token", "cls", "root", "sketch", "prefix", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
        )

        def compare(table: pa.Table) -> pa.Table:
            cls, mine = table["cls"].to_pylist(), table["mine"].to_numpy()
            _, root = np.unique(np.array(table["root"].to_pylist(), object), return_inverse=True)
            sketch, main = _sketches(table["sketch"]), np.bincount(root).argmax()
            left, right = mine == table["i"][0].as_py(), mine == table["j"][0].as_py()
            posted = _posted(table["prefix"])
            here = table["token"][0].as_py() >> 32
            found: list[tuple[bytes, bytes]] = []
            cut = False
            # pairs with the largest component are found from the other side
            for x in np.flatnonzero(root != main):
                there = np.flatnonzero((root != root[x]) & ((right & left[x]) | (left & right[x])) & ((root == main) | (np.arange(len(cls)) > x)))
                there = there[(sketch[there, :GLANCE] == sketch[x, :GLANCE]).sum(1) >= GLANCE_MATCHES]
                near = (sketch[there] == sketch[x]).sum(1)
                # a pair belongs to the first list that both are in
                ok = (near >= SKETCH_MATCHES) & ((posted[there] == posted[x]).argmax(1) == here)
                there, near = there[ok], near[ok]
                order = np.lexsort((-near, root[there]))
                there = there[order]
                place = np.arange(len(there)) - np.searchsorted(root[there], root[there])
                cut |= bool((place >= most).any())
                found += [(min(cls[x], cls[y]), max(cls[x], cls[y])) for y in there[place < most]]
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.Table.from_arrays(
                [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array([cut] * len(a), pa.bool_())], names=["a", "b", "cut"]
            )

        found = rows.groupBy("token", "i", "j").applyInArrow(compare, "a binary, b binary, cut boolean")
        found = self.ws.write(found.groupBy("a", "b").agg(F.max("cut").alias("cut")), f"across{self.round}")
        return found.select("a", "b"), bool(found.agg(F.max("cut")).first()[0])


def near_duplicates(docs: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each input row.

    Defined cases: a text without words (null, too) has an empty set and is linked with
    nothing; one of fewer than five words has one shingle; equal sets are linked
    whatever the texts; rows without id take part, but do not name a component unless
    all its rows lack one, and are kept only then; repeated rows share their verdict; an
    empty table gives an empty result; other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = ws.write(docs.mapInArrow(_sign, SIGNED), "signed")
    classes = ws.write(
        signed.where("n_shingles > 0")
        .groupBy("cls")
        .agg(F.min("doc_id").alias("least"), F.first("slot").alias("slot"), F.first("signature").alias("signature")),
        "classes",
    )
    linker = _Linker(classes, docs, ws)
    linker.confirm(linker.stars().select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    most, roots = 1, None
    while True:
        links = linker.all_links()
        roots = None if links is None else ws.write(components(links, ws, f"forest{linker.round}"), f"roots{linker.round}")
        pairs, more = linker.across(roots, most)
        tried = linker.confirm(pairs)
        if not more:  # all pairs of different components were among these
            break
        most = most * 1000
    if tried:
        roots = ws.write(components(linker.all_links(), ws, "forest_last"), "roots_last") if linker.links else None
    named = classes.select("cls", "least")
    if roots is not None:
        rooted = named.join(roots.select(F.col("u").alias("cls"), "root").hint("merge"), "cls")
        least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        rooted = rooted.select("cls", "root").join(least.hint("merge"), "root").select("cls", "component_id")
        named = named.join(rooted.hint("merge"), "cls", "left").select("cls", F.coalesce("component_id", "least").alias("component_id"))
    else:
        named = named.select("cls", F.col("least").alias("component_id"))
    named = ws.write(named, "named")
    ws.keep_only("signed", "named")
    verdicts = signed.select("doc_id", "n_shingles", "cls").join(named.hint("merge"), "cls", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return verdicts.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def drop_near_copies(docs: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of the ids that are kept; of each group one document."""
    kept = near_duplicates(docs, ws, id_col, text_col).where("kept").select(F.col("doc_id").alias("id"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"))
    return (
        rows.alias("d")
        .join(kept.alias("k").hint("merge"), F.col("d.id").eqNullSafe(F.col("k.id")), "left_semi")
        .select("row.*")
    )


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` at a similarity of 0.75."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "op6"))


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n, sha256(string_agg(g, chr(10) ORDER BY g)) AS cls FROM s GROUP BY doc_id
), c AS (
  SELECT cls, min(doc_id) AS rep, min(n) AS n FROM n GROUP BY cls
), cs AS (
  SELECT doc_id, g FROM s JOIN c ON s.doc_id = c.rep
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM cs x JOIN cs y ON x.g = y.g AND x.doc_id < y.doc_id
  JOIN c cx ON cx.rep = x.doc_id JOIN c cy ON cy.rep = y.doc_id
  GROUP BY x.doc_id, y.doc_id, cx.n, cy.n
  HAVING 100 * count(*) >= 75 * (cx.n + cy.n - count(*))
), e AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(node, to_node) AS (
  SELECT rep, rep FROM c
  UNION
  SELECT reach.node, e.b FROM reach JOIN e ON reach.to_node = e.a
), comp AS (
  SELECT node, min(to_node) AS component_id FROM reach GROUP BY node
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.component_id, d.doc_id) AS component_id,
       coalesce(comp.component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (cls) LEFT JOIN comp ON comp.node = c.rep
"""
