"""Text, date and nested-value functions of the metadata and report layers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rhopool.functions import stats as S


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Word lists, prefixes and patterns that decide a class.
CONTROL_WORDS = ["control", "ctrl", "healthy", "normal"]
SEPSIS_WORDS = ["sepsis", "infection", "infected"]
CONDITION_TEXT = {"control": "Control/Healthy sample", "sepsis": "Sepsis/Infected sample",
                  "unknown": "Unknown/Unclassified sample"}
CONDITION_TEXT_DEFAULT = "Unknown sample type"
GENE_SYMBOL_PATTERN = r"^[A-Za-z0-9_-]+$"
SAMPLE_PATTERN = r"^SRR\d+$"
STUDY_PATTERN = r"[A-Za-z]{2,3}-[A-Za-z]{3}-\d+|[A-Za-z]{3}\d+"
SAMPLE_NUMBER_PATTERNS = [r"(?i)Sample\s*(\d+)", r"(?i)S(\d+)", r"(\d+)"]
DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy", "dd/MM/yyyy"]
TITLE_LENGTH, DESCRIPTION_LENGTH, SAMPLE_TITLE_LENGTH = 500, 4000, 200
NUMBER_PATTERN = r"-?\d+(?:\.\d+)?(?:[eE][+\-]?\d+)?"
DEFAULT_LABEL_KEYS = {"UNKNOWN": 0, "CONTROL": 1, "SEPSIS": 2, "SEPTIC_SHOCK": 3, "NO_SEPSIS": 4}
TECHNOLOGIES = ["RNA-SEQ", "MICROARRAY", "OTHER"]


def condition_of_title(title, extended: bool = False) -> Column:
    """control / sepsis / unknown by contained words; ``extended`` recognises septic shock first."""
    t = F.lower(_c(title))
    out = F.when(t.rlike("|".join(CONTROL_WORDS)), "control").when(t.rlike("|".join(SEPSIS_WORDS)), "sepsis")
    if extended:
        out = F.when(t.rlike("septic[ _-]?shock"), "septic shock").otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


def condition_description(cond) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CONDITION_TEXT.items() for x in kv])
    return F.coalesce(F.try_element_at(table, _c(cond)), F.lit(CONDITION_TEXT_DEFAULT))


def gene_description(symbol) -> Column:
    return F.concat(F.lit("Gene: "), _c(symbol))


def sample_number(title) -> Column:
    """First number found by the ordered patterns; NULL without one."""
    tries = [F.regexp_extract(_c(title), p, 1) for p in SAMPLE_NUMBER_PATTERNS]
    # An earlier match wins even over a later one, so pick the text first and cast once.
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in tries]).try_cast("long")


# The marks of each kind and their order, in which the first match wins (gene_type, platform_type, technology).
def gene_type(symbol) -> Column:
    s = F.upper(_c(symbol))
    return (F.when(s.startswith("MIR") | s.startswith("LET"), "miRNA")
            .when(s.contains("LINC") | s.startswith("LNC"), "lncRNA")
            .when(s.startswith("RPL") | s.startswith("RPS"), "rRNA")
            .when(s.startswith("TRNA"), "tRNA")
            .when(s.endswith("P"), "pseudogene").otherwise("protein_coding"))


def platform_type(name) -> Column:
    s = F.upper(_c(name))
    return (F.when(s.contains("ILLUMINA"), "ILLUMINA").when(s.contains("AFFY"), "AFFYMETRIX")
            .when(s.contains("AGILENT"), "AGILENT").otherwise("OTHER"))


def technology(name) -> Column:
    s = F.upper(_c(name))
    return (F.when(s.contains("RNA-SEQ") | s.contains("RNA SEQ"), "RNA-SEQ")
            .when(s.contains("ARRAY"), "MICROARRAY").otherwise("OTHER"))


def truncate(c, n: int) -> Column:
    return F.substring(_c(c), 1, n)


def parse_date(c) -> Column:
    """Timestamp by the first matching format; NULL if none fits."""
    return F.coalesce(*[F.try_to_timestamp(_c(c), F.lit(f)) for f in DATE_FORMATS])


def label_key(label, mapping: dict[str, int] | None = None) -> Column:
    """Integer labels pass through; others are looked up by trimmed upper-case name."""
    m = F.create_map(*[F.lit(x) for kv in (mapping or DEFAULT_LABEL_KEYS).items() for x in kv])
    t = F.upper(F.trim(_c(label)))
    return F.coalesce(t.try_cast("int"), F.try_element_at(m, t))


def metrics_map(items) -> Column:
    """array of "name: value" texts -> map; a text without a colon maps to NULL; a later name wins."""
    def entry(x):
        parts = F.split(x, ":", 2)
        return F.struct(F.trim(parts[0]).alias("key"),
                        F.when(F.size(parts) > 1, F.trim(F.try_element_at(parts, F.lit(2)))).alias("value"))
    entries = F.transform(F.filter(_c(items), lambda x: x.isNotNull()), entry)
    n = F.size(entries)
    last = F.filter(entries, lambda e, i: ~F.exists(
        F.slice(entries, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def first_number(text) -> Column:
    """The text as a number, else the first finite number inside it."""
    t = _c(text)
    found = F.transform(F.regexp_extract_all(t, F.lit(f"({NUMBER_PATTERN})")), lambda x: S.finite(x.try_cast("double")))
    return F.coalesce(S.finite(F.trim(t).try_cast("double")),
                      F.try_element_at(F.filter(found, lambda x: x.isNotNull()), F.lit(1)))


def all_numbers(text) -> Column:
    return F.transform(F.regexp_extract_all(_c(text), F.lit(f"({NUMBER_PATTERN})")), lambda x: x.try_cast("double"))


def map_float(m, key: str) -> Column:
    return first_number(F.try_element_at(_c(m), F.lit(key)))


def map_interval(m, key: str, low_key: str | None = None, high_key: str | None = None) -> Column:
    """struct(low, high) from a two-number value or from two separate keys."""
    nums = all_numbers(F.try_element_at(_c(m), F.lit(key)))
    pair = F.when(F.size(nums) >= 2, F.struct(nums[0].alias("low"), nums[1].alias("high")))
    if low_key and high_key:
        pair = F.coalesce(pair, F.struct(map_float(m, low_key).alias("low"), map_float(m, high_key).alias("high")))
    return pair


# Schema of a verdict document.
VERDICT_SCHEMA = ("verdict string, rationale array<string>, red_flags array<string>, "
                  "supporting_metrics array<string>, recommendations array<string>")


def parse_verdict(c) -> Column:
    return F.from_json(_c(c), VERDICT_SCHEMA)


def row_payload(cols: list[str]) -> Column:
    return F.to_json(F.struct(*cols))


def feasibility() -> dict[str, Column]:
    """Rule form of the feasibility rubric on the shock-vs-sepsis contrast, with red flags."""
    q, d, k = F.col("q_ss"), F.abs("dz_ss_mean"), F.col("kappa_ss")
    i2, n = F.col("dz_ss_I2"), F.col("n_studies_ss")
    flags = F.array_compact(F.array(
        F.when(F.coalesce(q > 0.05, F.lit(True)), "not significant"),
        F.when(F.coalesce(d < 0.40, F.lit(True)), "small effect"),
        F.when(F.coalesce(k < 0.70, F.lit(True)), "low consistency"),
        F.when(i2 >= 75, "very high heterogeneity").when(i2 >= 60, "moderate heterogeneity"),
        F.when(F.coalesce(n < 2, F.lit(True)), "too few studies")))
    good = (q <= 0.05) & (d >= 0.40) & (k >= 0.70) & (i2 < 60)
    # Borderline q or effect leaves a single weakness; clear failures are negative.
    bad = (q > 0.10) | (d < 0.20) | (i2 >= 75) | (k < 0.50) | (n < 2) | q.isNull() | d.isNull() | k.isNull()
    return {"verdict": F.when(good & (n >= 2), "GOOD").when(bad, "NEGATIVE").otherwise("MODERATE"),
            "red_flags": flags}


def hover_text() -> Column:
    return F.format_string("%s - %s | p_ss %.4f | p_soth %.4f", "GeneAName", "GeneBName", "p_ss", "p_soth")
