"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per rule, so a policy
is only a mask over bits: applying another version, or asking what a rule costs on its own, never reads a text again.

Edge cases: a null or empty text has no words, fails ``few_words`` and nothing that divides by words; repeated rows
are judged row by row; an empty table gives an empty ledger; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textstats
from .common import bounded_batches

#: name, and the SQL condition under which a document fails; the position in this list is the rule's bit.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("shouting", "2 * n_upper > n_letters AND n_letters >= 20"),
    ("exclaiming", "10 * n_exclaim > 3 * n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("stuttering", "10 * n_same_next > 2 * n_words"),
    ("word_length", "word_chars > 15 * n_words OR word_chars < 2 * n_words"),
)
BITS = " | ".join(f"CAST(CASE WHEN {sql} THEN {1 << k} ELSE 0 END AS LONG)" for k, (_, sql) in enumerate(RULES))
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: any failure among ``hard`` rejects, and so do more than ``allowed`` failures among ``soft``."""

    version: str
    hard: int
    soft: int = 0
    allowed: int = 0

    def rejects(self, failures):
        hard = failures.bitwiseAND(F.lit(self.hard)) != 0
        return hard | (F.bit_count(failures.bitwiseAND(F.lit(self.soft))) > self.allowed)


BASE = BIT["few_words"] | BIT["repeated_windows"]
BASE_POLICY = Policy("base", BASE)
STRICT = Policy("v1", BASE | BIT["symbols"] | BIT["shouting"] | BIT["exclaiming"] | BIT["duplicate_lines"] | BIT["stuttering"], BIT["word_length"], 0)
#: Ablation of v1 against labels: no document that ``duplicate_lines`` alone rejects is labelled bad, so v2 only records that bit.
POLICY = Policy("v2", STRICT.hard & ~BIT["duplicate_lines"] | BIT["word_length"])
LENIENT = Policy("lenient", BASE, BIT["symbols"] | BIT["shouting"] | BIT["exclaiming"] | BIT["duplicate_lines"] | BIT["stuttering"], 1)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, every measurement, ``failures`` (bit k set: rule k failed)."""
    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), textstats.stats(F.col(text_col).cast("binary")).alias("m"))
    return rows.select("doc_id", "m.*").withColumn("failures", F.expr(BITS))


def judged(rows: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """The ledger with ``base_failed`` and the policy's ``kept``; the base rules reject under every policy."""
    base = F.col("failures").bitwiseAND(F.lit(BASE)) != 0
    return rows.withColumn("base_failed", base).withColumn("kept", ~base & ~policy.rejects(F.col("failures")))


def ablations(rows: DataFrame, policies: tuple[Policy, ...] = (POLICY, STRICT, LENIENT, BASE_POLICY)) -> DataFrame:
    """Per policy and rule: how many documents the rule fails, the policy rejects, and only this rule makes it reject.

    Documents collapse to at most 2^rules distinct failure masks before anything else, so this reads the ledger once.
    """
    masks = rows.groupBy("failures").agg(F.count("*").alias("n"))
    cases = F.explode(F.array(*[
        F.struct(F.lit(p.version).alias("policy"), F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit"), p.rejects(F.col("failures")).alias("rejected"), p.rejects(F.col("failures").bitwiseAND(F.lit(~bit))).alias("rejected_without"))
        for p in policies for name, bit in BIT.items()
    ])).alias("c")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    fails = F.col("failures").bitwiseAND(F.col("c.bit")) != 0
    return masks.select("failures", "n", cases).groupBy("c.policy", "c.rule").agg(
        total(fails).alias("n_failed"), total(F.col("c.rejected")).alias("n_rejected"), total(F.col("c.rejected") & ~F.col("c.rejected_without")).alias("n_only_this"),
    )


def kept_documents(docs: DataFrame, policy: Policy = POLICY, text_col: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, all columns unchanged. Judged in place: no join, so no key is needed."""
    held = bounded_batches(docs).select(F.struct("*").alias("row"), textstats.stats(F.col(text_col).cast("binary")).alias("m"))
    found = held.select("row", "m.*").select("row", F.expr(BITS).alias("failures"))
    good = (F.col("failures").bitwiseAND(F.lit(BASE)) == 0) & ~policy.rejects(F.col("failures"))
    return found.where(good).select("row.*")
