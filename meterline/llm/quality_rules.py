"""Quality rules as a bitmask ledger, in SQL functions only.

Every rule is evaluated once per document.  The ledger keeps the
measurements and one bit per failed rule (``fail_bits``); a policy is then a
mask over those bits plus the number of failures that rejects, so policies
are versioned, applied and compared without reading a text again.  Ablations
("what would dropping rule r keep?") are bit arithmetic over counts grouped
by ``fail_bits``: at most 2^rules rows, whatever the corpus.

All measures are local to a row: no shuffle, no skew.

Defined cases: a null or empty text has no words and fails ``few_words``;
repeated rows are judged alike; ``doc_id`` may be null; extra columns are
ignored by :func:`ledger` and passed on by :func:`apply_policy`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from meterline.llm.common import SPACE, fresh, plain_words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``failed`` is a SQL condition over the measures."""
    name: str
    failed: str


# Bit i of fail_bits is rule i; append only, so stored ledgers stay readable.
RULES: tuple[Rule, ...] = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 60 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("upper_case", "2 * n_upper > word_chars"),
)
BASE_MASK = 0b11


@dataclass(frozen=True)
class Policy:
    """Reject when at least ``min_failures`` of the rules in ``mask`` fail."""
    name: str
    version: int
    mask: int
    min_failures: int = 1

    def rejects(self, fail_bits: Column) -> Column:
        return F.bit_count(fail_bits.bitwiseAND(F.lit(self.mask).cast("long"))) >= self.min_failures


POLICIES: tuple[Policy, ...] = (
    Policy("base", 1, BASE_MASK),
    Policy("strict", 1, 0b001111),
    Policy("strict", 2, 0b1111111),
    Policy("lenient", 1, 0b1111111, 2),
)
DEFAULT_POLICY = POLICIES[2]


def _hash(a: Column, b: Column, d: Column) -> Column:
    return F.xxhash64(a, b, d)


def _measures(text: Column) -> list[dict[str, Column]]:
    """Projection steps; each refers to the columns of the earlier ones."""
    c = F.col
    lo = F.bitwise_not(c("__hi"))
    window = lambda i: _hash(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2))
    word = lambda p, j: F.get("__w", (p + j).cast("int"))
    is_in = lambda x, i: (F.get("__e", i)["a"] == x["a"]) & (F.get("__e", i)["b"] == x["b"]) & (F.get("__e", i)["d"] == x["d"])
    same = lambda x, i: F.get("__s", i).bitwiseAND(c("__hi")) == x.bitwiseAND(c("__hi"))
    none = F.array().cast("array<bigint>")
    return [
        {"__t": F.coalesce(text, F.lit(""))},
        {"__w": plain_words(c("__t")),
         "__l": F.filter(F.split("__t", "\n"), lambda x: x.rlike(SPACE.replace("[", "[^", 1))),
         "n_symbols": F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long"),
         "n_upper": F.regexp_count("__t", F.lit("[A-Z]")).cast("long")},
        {"n_words": F.size("__w").cast("long"), "word_chars": F.length(F.array_join("__w", "")).cast("long"),
         "n_lines": F.size("__l").cast("long"),
         "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
         # low bits hold a position, the others the window's hash
         "__hi": -F.expr("shiftleft(1L, length(bin(size(__w))))")},
        # one long per window; equal windows become neighbours when sorted
        {"__s": F.when(c("n_words") >= 3, F.sort_array(F.transform(
            F.sequence(F.lit(0).cast("long"), c("n_words") - 3),
            lambda i: window(i.cast("int")).bitwiseAND(c("__hi")).bitwiseOR(i)))).otherwise(none)},
        {"__c": F.transform(F.filter("__s", lambda x, i: F.coalesce(same(x, i - 1), F.lit(False))
                                     | F.coalesce(same(x, i + 1), F.lit(False))),
                            lambda x: x.bitwiseAND(lo))},
        # the hash only finds candidates; they are sorted again by their words
        {"__e": F.sort_array(F.transform("__c", lambda p: F.struct(
            word(p, 0).alias("a"), word(p, 1).alias("b"), word(p, 2).alias("d"), p.alias("p"))))},
        {"__p": F.transform(F.filter("__e", lambda x, i: F.coalesce(is_in(x, i - 1), F.lit(False))
                                     | F.coalesce(is_in(x, i + 1), F.lit(False))), lambda x: x["p"])},
        {"n_repeat_words": F.size(F.array_distinct(F.concat(
            c("__p"), F.transform("__p", lambda p: p + 1), F.transform("__p", lambda p: p + 2)))).cast("long")},
    ]


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, columns named in ``keep``, the measures and ``fail_bits``.

    Windows of three words that share the bits of a hash which their position
    leaves in a long are compared by their words, so the measures are exact for
    texts of any length."""
    ids = [id_col, *keep]
    renamed = {n: f"__id{i}" for i, n in enumerate(ids)}
    out = docs.select(*[F.col(f"`{n}`").alias(a) for n, a in renamed.items()], F.col(f"`{text_col}`").alias("__text"))
    for step in _measures(F.col("__text")):
        out = out.withColumns(step)
    bits = F.lit(0).cast("long")
    for i, r in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(r.failed), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return out.select(*[F.col(a).alias(n) for n, a in renamed.items()], *MEASURES, bits.alias("fail_bits"))


def verdicts(led: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """The ledger with one boolean per policy version, ``kept_<name>_v<version>``."""
    return led.withColumns({f"kept_{p.name}_v{p.version}": ~p.rejects(F.col("fail_bits")) for p in policies})


def ablation(led: DataFrame, policies: tuple[Policy, ...] = POLICIES,
             rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per policy version and rule: documents failing the rule, documents the
    policy rejects, and documents kept if the policy lost that rule."""
    spark = led.sparkSession
    counts = led.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rows = [(p.name, p.version, p.mask, p.min_failures, i, r.name) for p in policies for i, r in enumerate(rules)
            if p.mask >> i & 1]
    table = spark.createDataFrame(rows, "policy string, version int, mask long, least int, bit int, rule string")
    # at most 2^rules counts against the fixed policy list
    cases = counts.select("n", "fail_bits", F.explode(F.array(*[F.lit(i) for i in range(len(rules))])).alias("bit"))
    with_policy = cases.join(F.broadcast(table), "bit")
    fails = F.col("fail_bits").bitwiseAND(F.expr("shiftleft(1L, bit)")) != 0
    now = F.bit_count(F.col("fail_bits").bitwiseAND(F.col("mask"))) >= F.col("least")
    without = F.bit_count(F.col("fail_bits").bitwiseAND(F.col("mask"))
                          .bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, bit)")))) >= F.col("least")
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return with_policy.groupBy("policy", "version", "rule").agg(
        total(fails).alias("n_fail"), total(now).alias("n_rejected"), total(now & ~without).alias("n_kept_without"))


def apply_policy(docs: DataFrame, policy: Policy = DEFAULT_POLICY, text_col: str = "text",
                 rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with all their columns."""
    (whole,) = fresh(docs, "__row")
    led = ledger(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole),
                             F.col(f"`{text_col}`").alias("__quality_text")), whole, "__quality_text", rules)
    # the row number keeps the filter above the projections: pushed below, the
    # measures would be written out inside their own array functions
    led = led.withColumn("__at", F.monotonically_increasing_id())
    return led.where(~policy.rejects(F.col("fail_bits")) & (F.col("__at") >= 0)).select(f"{whole}.*")
