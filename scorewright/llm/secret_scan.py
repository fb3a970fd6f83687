"""Secret scans with multipart credential linking, built from DataFrame functions only.

Strong kinds (assignments to secret names, access identifiers, long hexadecimal runs) are always reported.  Weak parts
(identifiers, short or unlabelled secrets, endpoints) are reported only when complementary parts start within one scope
of each other.  That test is an interval join: parts are binned by the scope's width, each bin keeps the first and last
start of each class, and a weak part probes its own and both neighbouring bins.  No pairs of parts are ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scorewright.llm._shared import materialize, text_or_empty

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Weak parts by class.
IDENTIFIER = r"""(?i:\b(?:user(?:name|_id)?|login|account|client_id|access_key(?:_id)?))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
WEAK_SECRET = r"""(?i:\b(?:pwd|pass|passphrase|credentials?|private_key|secret_key))["']?\x20*[:=]\x20*["']?[^\s"']{4,}|(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"""
ENDPOINT = r"""(?i:\b[a-z][a-z0-9+.-]*://[^\s"'<>]+|\b(?:host|hostname|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{4,})"""
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
#: Characters within which complementary parts must start.
SCOPE = 300
_SPAN = "array<struct<start:int,kind_no:int,end:int>>"


#: Patterns by kind, and the least length of their second group.
PATTERNS = {"assign": (ASSIGN, 8), "access": (ACCESS, 0), "hex": (HEX, 0), "weak_id": (IDENTIFIER, 0), "weak_secret": (WEAK_SECRET, 0), "endpoint": (ENDPOINT, 0)}


def with_spans(df: DataFrame, text: str) -> DataFrame:
    """Adds a column ``_<kind>`` for each kind: leftmost non-overlapping matches as (start, kind_no, end).

    Places are in code points, end exclusive; they come from the lengths of the matches and of the text between them.
    Each step is a column of its own, so that no pattern runs again inside a lambda.
    """
    none = F.array().cast("array<string>")
    df = df.withColumns({f"_f_{k}": F.when(F.col(text).rlike(p), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for k, (p, _) in PATTERNS.items()})
    df = df.withColumns({f"_b_{k}": F.when(F.size(f"_f_{k}") > 0, F.split(text, p, -1)).otherwise(none) for k, (p, _) in PATTERNS.items()} | {f"_v_{k}": F.when(F.size(f"_f_{k}") > 0, F.regexp_extract_all(text, F.lit(p), F.lit(2))) for k, (p, n) in PATTERNS.items() if n})
    return df.withColumns({f"_{k}": _placed(k) for k in PATTERNS}).drop(*[f"_{x}_{k}" for x in "fbv" for k in PATTERNS])


def _upto(parts: Column) -> Column:
    """Characters of all parts before each one; made in one pass."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at"))
    return F.aggregate(parts, start, lambda s, x: F.struct((s["n"] + F.char_length(x)).alias("n"), F.concat(s["at"], F.array(s["n"])).alias("at")))["at"]


def _placed(kind: str) -> Column:
    found, values, longest = f"_f_{kind}", f"_v_{kind}", PATTERNS[kind][1]

    def spans(before: Column) -> Column:
        def place(match: Column, i: Column) -> Column:
            # Up to a match stand all matches before it, and the text between them and before the match itself.
            start = F.get(before["found"], i) + F.get(before["between"], i + 1)
            span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), (start + F.char_length(match)).alias("end"))
            return F.when(F.char_length(F.get(values, i)) >= longest, span) if longest else span

        return F.filter(F.transform(found, place), lambda p: p.isNotNull())

    # The totals are bound to a name, so that they are made once for a text.
    return F.transform(F.array(F.struct(_upto(F.col(found)).alias("found"), _upto(F.col(f"_b_{kind}")).alias("between"))), spans)[0]


def written(all_spans: Column) -> Column:
    """``kind:start:end`` by start, then kind in the order of KINDS, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(all_spans), lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def linked_parts(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(_row, extra): the weak spans of each row whose complement starts within ``scope`` characters.

    A weak identifier needs a secret, a weak secret an identifier, an endpoint both.
    """
    no = KINDS.index
    part = rows.where(F.size("_weak") > 0).select("_row", F.explode(F.concat("_base", "_weak")).alias("s")).select("_row", "s.*").withColumn("bin", F.floor(F.col("start") / scope))
    role = F.when(F.col("kind_no").isin(no("access"), no("weak_id")), F.lit("id")).when(F.col("kind_no") != no("endpoint"), F.lit("secret"))
    bins = part.withColumn("role", role).where("role is not null").groupBy("_row", "bin", "role").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    probe = part.where(F.col("kind_no") >= no("weak_id")).withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    # Within a bin a start lies between first and last, so one of both is within the scope exactly if any start is,
    # in the neighbouring bins; in the own bin all are.
    near = (F.abs(F.col("first") - F.col("start")) <= scope) | (F.abs(F.col("last") - F.col("start")) <= scope)
    met = probe.join(bins, ["_row", "bin"]).where(near).groupBy("_row", "start", "kind_no", "end").agg(F.bool_or(F.col("role") == "id").alias("has_id"), F.bool_or(F.col("role") == "secret").alias("has_secret"))
    needs = F.when(F.col("kind_no") == no("weak_id"), F.col("has_secret")).when(F.col("kind_no") == no("weak_secret"), F.col("has_id")).otherwise(F.col("has_id") & F.col("has_secret"))
    return met.where(needs).groupBy("_row").agg(F.collect_list(F.struct("start", "kind_no", "end")).alias("_extra"))


def scan_secrets(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """Find secrets in every whole text; returns the columns of ``docs`` without ``text`` and the findings.

    Adds n_assign, n_access, n_hex (long), base_spans and spans (strings of ``kind:start:end``) and base_sha256.  A null
    text counts as empty and has no spans.  Columns of ``docs`` with the names of results are replaced; repeated rows
    are scanned one by one.
    """
    keep = [c for c in docs.columns if c not in {text, "n_assign", "n_access", "n_hex", "base_spans", "base_sha256", "spans"}]
    rows = with_spans(docs.select(F.monotonically_increasing_id().alias("_row"), *keep, text_or_empty(text).alias("_text")), "_text").drop("_text")
    rows = rows.withColumns({"_base": F.concat("_assign", "_access", "_hex"), "_weak": F.concat("_weak_id", "_weak_secret", "_endpoint")}).drop("_weak_id", "_weak_secret", "_endpoint")
    # What a strong kind has taken is no weak part.
    rows = rows.withColumn("_weak", F.filter("_weak", lambda w: ~F.exists("_base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))))
    # Both the rows and their parts are read from here, so the row numbers agree; texts do not move.
    rows = materialize(rows, "secrets")
    out = rows.join(linked_parts(rows, scope), "_row", "left")
    listed = written(F.col("_base"))
    return out.select(
        *keep,
        F.size("_assign").cast("long").alias("n_assign"), F.size("_access").cast("long").alias("n_access"), F.size("_hex").cast("long").alias("n_hex"),
        listed.alias("base_spans"), F.sha2(listed, 256).alias("base_sha256"),
        written(F.concat("_base", F.coalesce("_extra", F.array().cast(_SPAN)))).alias("spans"),
    )
