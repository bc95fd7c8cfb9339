"""Secret scans with an incremental blob ledger (operator 8).

Every version of every path is content-addressed (SHA-256). The ledger holds a row for
each pair of blob and rule version that was ever scanned, with its findings, in a folder
for each rule version; a run scans only blobs whose pair is not there, once each however
many paths and versions hold them, appends them, and joins findings back to all of them.
The rule version is a digest of the rules, so an edited rule is a new one.

Texts that one path holds and the ledger lacks, nearly all, are scanned where they are
read. Which others there are is told by a bitmap of bounded size over hashes of digests;
those few texts are shuffled by digest, one of each kept, and the ones the ledger lacks
are scanned. A false hit of the bitmap only takes the longer way.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.llm.bitmap import bitmap_of, bits_for, has
from tessellar.llm.workspace import Workspace, list_names

#: Kinds of the base contract: pattern, group whose length counts, least length.
BASE = (
    (
        "assign",
        re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII),
        2,
        12,
    ),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),
)
#: A text without any of these (in lower case) has no match of the kind.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Kinds that this operator adds, with a string that every match holds.
ADDED = (
    ("private_key", "-----BEGIN", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----)?")),
    ("forge_token", "gh", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", re.ASCII)),
    ("chat_token", "xox", re.compile(r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}")),
    ("web_token", "eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", re.ASCII)),
    ("map_key", "AIza", re.compile(r"\bAIza[A-Za-z0-9_-]{35}", re.ASCII)),
    ("payment_key", "k_live_", re.compile(r"\b[rs]k_live_[A-Za-z0-9]{16,}", re.ASCII)),
    ("url_password", "://", re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@]+:[^\s:/@]{3,}@", re.ASCII)),
)

#: A digest of all rules: blobs are scanned again whenever one changes.
RULE_VERSION = hashlib.sha256(
    repr(
        (
            [(kind, pattern.pattern, pattern.flags, group, least) for kind, pattern, group, least in BASE],
            ASSIGN_WORDS,
            [(kind, needle, pattern.pattern, pattern.flags) for kind, needle, pattern in ADDED],
        )
    ).encode()
).hexdigest()[:16]

FINDINGS = "sha string, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and added spans (start, end, kind) in code points, by start, then kind as listed."""
    found: list[tuple[int, int, int, str]] = []
    lowered = text.lower()
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        # lower() leaves ASCII letters where they are needed: only a test for presence
        if kind == "assign" and not any(w in lowered for w in ASSIGN_WORDS):
            continue
        if kind == "access" and "AKIA" not in text:
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), rank, m.end(), kind))
    base = [(a, b, kind) for a, _, b, kind in sorted(found)]
    for rank, (kind, needle, pattern) in enumerate(ADDED, len(BASE)):
        if needle in text:
            found += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text)]
    return base, [(a, b, kind) for a, _, b, kind in sorted(found)]


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for sha, text in zip(batch["sha"].to_pylist(), batch["text"], strict=True):
            base, spans = scan(text.as_py() or "")
            n = [sum(kind == k for _, _, kind in base) for k, *_ in BASE]
            rows.append((sha, RULE_VERSION, *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["sha", "rule_version", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


class BlobLedger:
    """Findings of every (blob, rule version) ever scanned, as Parquet under ``path``, a folder for each rule version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @property
    def folder(self) -> str:
        return f"{self.path}/rules={RULE_VERSION}"

    def read(self) -> DataFrame:
        """What these rules found, a row for each blob (two runs at once may have scanned the same one); empty where nothing was."""
        if not list_names(self.spark, self.folder):
            return self.spark.createDataFrame([], FINDINGS)
        return self.spark.read.schema(FINDINGS).parquet(self.folder).dropDuplicates(["sha"])

    def append(self, findings: DataFrame) -> None:
        findings.write.mode("append").parquet(self.folder)


def scan_secrets(
    docs: DataFrame,
    ledger: BlobLedger,
    ws: Workspace,
    id_col: str = "doc_id",
    text_col: str = "text",
    version_col: str | None = None,
    bits: int | None = None,
) -> DataFrame:
    """Scan what the ledger has not seen and return findings for every version of every path.

    ``id_col`` is the path; with ``version_col`` a path has a row for each of its versions.
    Returns ``doc_id`` (and ``version``, if there is one), ``sha256, n_assign, n_access,
    n_hex, base_sha256, spans``, a row for each input row, those without findings too.

    Defined cases: a null text is an empty one; null and repeated ids and versions are kept
    as they are; equal texts are scanned once; an empty table gives an empty result; other
    columns are not read.
    """
    text = F.col(f"`{text_col}`")
    sha = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    names = [F.col(f"`{id_col}`").alias("doc_id")] + ([F.col(f"`{version_col}`").alias("version")] if version_col else [])
    paths = ws.write(docs.select(*names, sha.alias("sha")), "paths")
    held = paths.groupBy("sha").agg(F.count(F.lit(1)).alias("n"))
    state = ws.write(
        held.join(ledger.read().select("sha", F.lit(True).alias("seen")).hint("merge"), "sha", "left"), "blobs"
    )
    several = state.where((F.col("n") > 1) | F.col("seen"))
    size = bits or bits_for(several.count())
    slot = (F.pmod(F.xxhash64("sha"), F.lit(size)) + 1).alias("slot")
    apart = docs.sparkSession.sparkContext.broadcast(bitmap_of(several.select(slot), size))

    def rows_where(marked: bool):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = has(apart.value, batch["slot"].to_numpy())
                yield batch.filter(pa.array(hit == marked)).select(["sha", "text"])

        return keep

    texts = docs.select(sha.alias("sha"), text.alias("text")).select("sha", slot, "text")
    alone = rows_where(False)
    ledger.append(texts.mapInArrow(lambda batches: _scan_batches(alone(batches)), FINDINGS))
    shared = texts.mapInArrow(rows_where(True), "sha string, text string").groupBy("sha").agg(F.first("text").alias("text"))
    unseen = state.where(F.col("seen").isNull()).select("sha")
    ledger.append(shared.join(unseen.hint("merge"), "sha", "left_semi").mapInArrow(_scan_batches, FINDINGS))
    # a row for each blob of this run, written: the join that follows is between two plain exchanges
    found = ws.write(state.select("sha").hint("merge").join(ledger.read(), "sha"), "found")
    ws.keep_only("paths", "found")
    return (
        paths.hint("merge")
        .join(found, "sha")
        .select("doc_id", *(["version"] if version_col else []), F.col("sha").alias("sha256"), "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    )


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against a ledger that begins empty."""
    ws = Workspace(spark, "op8")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan_secrets(docs, BlobLedger(spark, ws.path("ledger")), ws).drop("sha256")
