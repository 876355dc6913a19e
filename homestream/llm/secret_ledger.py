"""Secrets: an incremental ledger of blobs.

Every version of a text is addressed by the SHA-256 of its UTF-8 bytes. The ledger has two tables. ``versions`` says
which paths held which blob in which run, for all runs; ``entries`` holds, per (blob, rule version), what a scan
found. A run writes its versions, scans the blobs that have no entry under the current rules, each once however many
paths hold it, and joins findings back to all paths, of this run or of all runs (:meth:`Ledger.history`).

Texts are read twice: once whole to be addressed, with a cheap literal test along the way, and once more for those
that pass it. Blobs that fail the test can't match and get an empty entry. Everything else reads the narrow versions
table, and the choice of one path per blob combines map-side. The scan is built-in functions.

Null counts as the empty text. A null or repeated identifier is an ordinary path. Other columns aren't read. An empty
table adds a run without versions and gives an empty result.
"""

import hashlib
import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from homestream.llm.common import shared_folder, text_of
from homestream.llm.spans import count_of, joined, spans_of, with_matches

#: Kinds in the order of their listing, base kinds first.
BASE = ("assign", "access", "hex")
ADDED = ("pem", "github", "slack", "jwt")
PATTERNS = {
    "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?+ *+[:=] *+["']?+([A-Za-z0-9+/_.=-]++)""",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
    "pem": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
    "github": r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}+",
    "slack": r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}+",
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+",
}
#: Without one of these a text holds no match of any kind.
KEYWORDS = (r"(?:[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[A-Za-z\"']{0,4} *+[:=]"
            r"|AKIA|[0-9a-f]{24}|PRIVATE KEY|gh[pousr]_|xox[abprs]-|eyJ")
#: Rule sets are told apart by their content.
RULES = hashlib.sha256(repr((sorted(PATTERNS.items()), KEYWORDS, BASE, ADDED)).encode()).hexdigest()[:16]
FINDINGS = "array<struct<start:bigint,ord:int,end:bigint,kind:string,value:string>>"
ENTRY = f"blob binary, rules string, findings {FINDINGS}"


def _valid(kind):
    return {
        "assign": lambda v, p, c: F.char_length(p) >= 6,
        "access": lambda v, p, c: F.char_length(v) >= 20,
    }.get(kind, lambda v, p, c: F.lit(True))


def scan(df: DataFrame, text="text") -> DataFrame:
    """Adds ``findings`` to each row: spans by start, then kind. Texts are searched whole."""
    names = [c for c in df.columns if c != text]
    t = F.col("_sec_text")
    rules = {k: (p, F.lit(True)) for k, p in PATTERNS.items()}
    base = df.select(*names, text_of(text).alias("_sec_text"))
    found = with_matches(base, t, rules, "_sec_", {"assign": 2})
    spans = F.array_sort(F.concat(*[
        spans_of(k, i, _valid(k), "_sec_", part=k == "assign") for i, k in enumerate((*BASE, *ADDED))]))
    return found.select(*names, F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind"),
        s["value"].alias("value"))).cast(FINDINGS).alias("findings"))


def addressed(df: DataFrame, text="text") -> DataFrame:
    """Adds ``blob`` (SHA-256 of the UTF-8 text) and ``suspect`` (holds a keyword)."""
    t = text_of(text)
    return df.withColumns({"blob": F.unhex(F.sha2(t.cast("binary"), 256)), "suspect": t.rlike(KEYWORDS)})


def _clean():
    return F.expr(f"cast(array() as {FINDINGS})")


class Ledger:
    """The two tables as Parquet batches in a shared folder.

    A run is a folder below each of ``versions`` and ``entries``, numbered in order. It counts once its entries, written
    last, have committed: a run that fails half-way leaves nothing that a reader sees.
    """

    def __init__(self, spark, path=None):
        self.spark, self.path = spark, path or shared_folder(spark, "blob-ledger")

    def runs(self):
        """Folder names of the committed runs, oldest first."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        root = path(f"{self.path}/entries")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(n for n in names if fs.exists(path(f"{self.path}/entries/{n}/_SUCCESS")))

    def entries(self, rules=RULES) -> DataFrame:
        """(blob, findings), one row for each blob that was scanned under the rules."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], ENTRY).select("blob", "findings")
        return (self.spark.read.schema(ENTRY).parquet(*[f"{self.path}/entries/{r}" for r in runs])
                .filter(F.col("rules") == rules).select("blob", "findings"))

    def versions(self, runs=None) -> DataFrame:
        """(path, blob, run), one row for each row of the runs' tables, by default of all runs."""
        parts = [self.spark.read.parquet(f"{self.path}/versions/{r}").select("path", "blob", F.lit(int(r[:8])).alias("run"))
                 for r in (self.runs() if runs is None else runs)]
        return reduce(DataFrame.unionByName, parts)

    def update(self, df: DataFrame, path="doc_id", text="text", rules=RULES) -> str:
        """Record every row's version, scan what the ledger doesn't know, commit. Returns the run's name."""
        before = self.runs()
        run = f"{int(before[-1][:8]) + 1 if before else 1:08d}-{uuid.uuid4().hex}"
        rows = df.select(F.col(path).alias("path"), F.col(text).alias("text"))
        rows.transform(addressed).select("path", "blob", "suspect").write.parquet(f"{self.path}/versions/{run}")
        narrow = self.spark.read.parquet(f"{self.path}/versions/{run}")
        chosen = narrow.groupBy("blob").agg(F.min("path").alias("path"), F.first("suspect").alias("suspect"))
        if before:
            chosen = chosen.join(self.entries(rules).select("blob"), "blob", "left_anti")
        one = chosen.filter("suspect").select(F.col("blob").alias("_blob"), F.col("path").alias("_path"))
        # the literal test first: only texts that pass it are hashed again and travel
        texts = rows.filter(text_of("text").rlike(KEYWORDS)).transform(addressed).select("blob", "path", "text")
        picked = texts.join(one, (F.col("blob") == F.col("_blob")) & F.col("path").eqNullSafe(F.col("_path"))).select("blob", "text")
        found = scan(picked).filter(F.size("findings") > 0).groupBy("blob").agg(F.first("findings").alias("findings"))
        new = chosen.select("blob").join(found, "blob", "left").select(
            "blob", F.lit(rules).alias("rules"), F.coalesce("findings", _clean()).alias("findings"))
        new.write.parquet(f"{self.path}/entries/{run}")
        return run

    def history(self, rules=RULES) -> DataFrame:
        """(path, run, blob, findings) of every version in every run: a secret stays with the run that held it, whatever
        the path holds now. ``findings`` is null where no run has scanned the blob under the rules."""
        known = self.entries(rules).select(F.col("blob").alias("_blob"), "findings")
        return self.versions().join(known, F.col("blob") == F.col("_blob"), "left").select("path", "run", "blob", "findings")


def find_secrets(df: DataFrame, path="doc_id", text="text", ledger: Ledger = None) -> DataFrame:
    """Rows of (path, findings): every row of ``df`` with what its blob holds."""
    ledger = ledger or Ledger(df.sparkSession)
    run = ledger.update(df, path, text)
    # after the run every blob of it has an entry: only those with findings need to meet their versions
    dirty = ledger.entries().filter(F.size("findings") > 0)
    return ledger.versions([run]).join(dirty, "blob", "left").select(
        F.col("path").alias(path), F.coalesce("findings", _clean()).alias("findings"))


def digest(found: DataFrame, path="doc_id") -> DataFrame:
    """One row per document: counts, hash of the base spans, all spans."""
    spans = F.col("findings")
    base = F.filter(spans, lambda s: s["ord"] < len(BASE))
    return found.select(
        path, *[count_of(spans, k).alias(f"n_{k}") for k in (*BASE, *ADDED)],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"))
