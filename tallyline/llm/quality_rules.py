"""Quality rules as a ledger: each rule is evaluated once, policies are applied to the bits.

``measure`` reads each text once and returns one row per document with its
measurements; ``ledger`` adds ``failures``, a bit for each rule that the
document fails. A ``Policy`` is a named choice of rules; ``apply_policy`` is one
bitwise and, so a new policy needs no second look at the texts, and ``ablations``
tells from counts per bit pattern what each rule of a policy decides alone.

Nulls and empty texts measure 0 and fail the rules on too few words. Repeated
rows are measured each on its own. Columns beside those named are not touched
by ``measure`` and ``ledger``, which return the identifier and their own
columns only. An empty table gives an empty result.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.words import (
    SPACE, Texts, hash_spans, is_in, lines_of, mix, repeated, shingle_hashes, slices, sums, words_of,
)

MEASURES = {
    "n_words": "words",
    "word_chars": "code points in words",
    "n_symbols": "characters of #*$%&|<>",
    "n_lines": "lines with a word",
    "n_dup_lines": "lines with a word that equal an earlier line",
    "n_repeat_words": "words in windows of three words that occur twice or more",
    "n_letters": "ASCII letters and characters beyond ASCII",
}

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_LETTER = np.array([chr(b).isalpha() or b >= 0xC0 for b in range(256)]) & ~((np.arange(256) >= 0x80) & (np.arange(256) < 0xC0))
_POINT = (np.arange(256) & 0xC0) != 0x80


def measure_texts(texts: Texts) -> dict[str, np.ndarray]:
    """MEASURES of each text."""
    data = texts.data
    word_bytes = ~SPACE[data]
    words, lines = words_of(texts), lines_of(texts)
    windows, at = shingle_hashes(hash_spans(data, words), words, 3)
    owner = words.owner()
    keys = windows ^ mix(owner[at].astype(np.uint64), 11)
    hits = at[is_in(keys, repeated(keys))]
    covered = np.zeros(len(owner) + 2, bool)
    for k in range(3):
        covered[hits + k] = True
    filled = sums(word_bytes, np.concatenate([lines.start, lines.end[-1:]])) > 0 if len(lines.start) else np.zeros(0, bool)
    line_owner = lines.owner()[filled]
    keys = hash_spans(data, lines)[filled] ^ mix(line_owner.astype(np.uint64), 13)
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return {
        "n_words": words.counts(),
        "word_chars": sums(word_bytes & _POINT[data], texts.offsets),
        "n_symbols": sums(_SYMBOL[data], texts.offsets),
        "n_lines": np.bincount(line_owner, minlength=len(texts)),
        "n_dup_lines": np.bincount(line_owner[again], minlength=len(texts)),
        "n_repeat_words": sums(covered[: len(owner)], words.before),
        "n_letters": sums(_LETTER[data], texts.offsets),
    }


def measure(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, one long column per measure), one row per row of ``docs``."""
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                columns = {name: pa.array(values, pa.int64()) for name, values in measure_texts(texts).items()}
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), **columns})

    kind = source.schema["doc_id"].dataType.simpleString()
    out = source.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{name} long" for name in MEASURES))
    return out.withColumnRenamed("doc_id", id_column)


@dataclass(frozen=True)
class Rule:
    """Fails where the condition, an SQL expression over the measurements, holds."""

    name: str
    fails: str


#: Bit k of ``failures`` is rule k: add rules at the end, never reorder them, so that stored ledgers stay valid.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "n_lines >= 4 and 10 * n_dup_lines > 6 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("few_letters", "10 * n_letters < 3 * word_chars"),
    Rule("no_words", "n_words = 0"),
)


@dataclass(frozen=True)
class Policy:
    """A version and the names of the rules whose failure rejects a document."""

    version: str
    rejects: tuple[str, ...]

    def bits(self, rules: tuple[Rule, ...] = RULES) -> int:
        unknown = set(self.rejects) - {rule.name for rule in rules}
        if unknown:
            raise ValueError(f"unknown rules: {sorted(unknown)}")
        return sum(1 << k for k, rule in enumerate(rules) if rule.name in self.rejects)


BASE_POLICY = Policy("base-1", ("few_words", "repeated_windows"))
#: Short clean documents are kept: few words alone say nothing about their quality.
PIPELINE_POLICY = Policy(
    "pipeline-1", ("no_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words", "few_letters")
)
FULL_POLICY = Policy("full-1", ("few_words", *PIPELINE_POLICY.rejects))


def failures(rules: tuple[Rule, ...] = RULES) -> Column:
    """The bits of the rules that fail; a condition that is null does not fail."""
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Measurements and ``failures`` of each document."""
    if len(rules) > 63:
        raise ValueError("a ledger holds up to 63 rules")
    return measure(docs, id_column, text_column).withColumn("failures", failures(rules))


def apply_policy(rows: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES, column: str = "kept") -> DataFrame:
    """Adds whether each ledger row passes, and the version that decided."""
    passed = F.col("failures").bitwiseAND(F.lit(policy.bits(rules)).cast("long")) == 0
    return rows.withColumns({column: passed, "policy": F.lit(policy.version)})


def ablations(rows: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of the policy: documents it fails, and those that only it rejects.

    The ledger shrinks to a count per bit pattern first, so this costs one
    narrow aggregation whatever the number of rules.
    """
    bits = F.lit(policy.bits(rules)).cast("long")
    patterns = rows.groupBy(F.col("failures").bitwiseAND(bits).alias("pattern")).agg(F.count("*").alias("n"))
    chosen = [(k, rule.name) for k, rule in enumerate(rules) if rule.name in policy.rejects]
    each = F.explode(F.array(*[F.struct(F.lit(1 << k).cast("long").alias("bit"), F.lit(name).alias("rule")) for k, name in chosen]))
    rule_rows = patterns.select("pattern", "n", each.alias("r")).select("pattern", "n", "r.bit", "r.rule")
    hit, alone = F.col("pattern").bitwiseAND(F.col("bit")) != 0, F.col("pattern") == F.col("bit")
    return rule_rows.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("only_this_rule"),
        F.lit(policy.version).alias("policy"),
    )


def keep_documents(docs: DataFrame, policy: Policy = PIPELINE_POLICY, rules: tuple[Rule, ...] = RULES, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, whole and unchanged, whose text passes the policy.

    Rows travel through the measuring step with their own columns, so nothing
    is joined and repeated or null identifiers need no care.
    """
    wanted, passed = policy.bits(rules), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "__text"):
                columns = {f"__{name}": pa.array(values, pa.int64()) for name, values in measure_texts(texts).items()}
                kept = part.drop_columns(["__text"])
                yield pa.RecordBatch.from_arrays([*kept.columns, *columns.values()], names=[*kept.schema.names, *columns])

    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    text = plain[names[docs.columns.index(text_column)]].cast("string")
    schema = ", ".join([*(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, passed.fields)), *(f"__{name} long" for name in MEASURES)])
    rows = plain.withColumn("__text", text).mapInArrow(run, schema)
    for name in MEASURES:
        rows = rows.withColumnRenamed(f"__{name}", name)
    rows = rows.filter(failures(rules).bitwiseAND(F.lit(wanted).cast("long")) == 0)
    return rows.select(*names).toDF(*docs.columns)
