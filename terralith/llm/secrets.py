"""Secret scans with Spark expressions only: base patterns and a randomness test battery.

Base spans (assign, access, hex) follow fixed patterns. The battery looks at other runs of
token characters. Known prefixes (``sk_live_``, ``ghp_`` and the like) are left out of the tests.
Every run has an encoding, the narrowest that fits: decimal, hex, base32, base36 in lower or
upper case, letters of one case, base62, or base64; in runs of one case, ``- _ + /`` are separators and
not symbols. Three tests ask whether the run could be uniform random symbols of it: chi-squared
over the alphabet, the number of runs above and below the alphabet's middle, and the lag-one
serial correlation. Runs with separators, unless these cut equal groups or a UUID, also take the
chi-squared test with the separator as a symbol; letters of one case take a test of the share of
vowels. Letters of fewer than ``ALPHA`` characters are tested over 36 symbols: over 26, so short
a word looks like a random run. The p-values combine by Bonferroni; a run that the battery
rejects at level ``LEVEL`` is not random and goes.

What is left must also be no text. The null hypothesis "structured" is a Markov chain over
characters: classes follow each other as in identifiers and paths (``TRANSITIONS``), letters as
in the corpus's own distinct words. The likelihood of uniform symbols of the encoding against
that chain is an e-value, so its inverse is a p-value for "structured" (a rejected run has 1).
Benjamini-Hochberg over it, in classes of encoding and length over all runs of the corpus,
bounds the share of structured runs among those reported (kind ``random``) by ``FDR``. Runs of
fewer than ``MIN_BITS`` bits are never reported, nor those that overlap a base span, nor those
that decode from base64 or hex to whole text: encoded words look uniform and are no key. A UUID
is as random as a key, may be one, and is reported. Evidence is
counted in whole bits per class, so the control needs one small grouped count whatever the size
of the corpus.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import free_name, materialise, table, text_or_empty
from terralith.llm.spans import apart, count_kind, find, let, normal_tail, ordered, replaced

# Fixed values of the base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # leftmost runs of [0-9a-f]+ that have 16 or more characters
KINDS = ["assign", "access", "hex", "random"]
ALPHABETS = {
    "dec": "0123456789",
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "letters": "0123456789abcdefghijklmnopqrstuvwxyz",
    "alpha": "abcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
PREFIX = r"^(?:[spr]k_(?:live|test)_|sk-(?:proj-|ant-)?|gh[pousr]_|github_pat_|glpat-|xox[abeprs]-|npm_|pypi-|hf_|whsec_|dop_v1_|shp(?:at|ca|pa|ss)_)"
#: Separators that cut equal groups of letters and digits, or a UUID.
GROUPS = "|".join([rf"^[0-9A-Za-z]{{{n}}}(?:[-_][0-9A-Za-z]{{{n}}})+$" for n in range(2, 9)] + [r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"])
ALPHA = 40
MIN_BITS = 96.0
LEVEL = 0.001
FDR = 0.05
#: Whole bits of evidence that are told apart.
MOST_BITS = 80
#: Characters of runs in the order of the chain's states; the start is one more state.
STATES = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_+/"
#: Shares of the class of the next character (lower, upper, digit, separator) by the class before
#: it in identifiers, paths and titles; the last row is the start.
TRANSITIONS = [(0.78, 0.08, 0.04, 0.10), (0.58, 0.28, 0.07, 0.07), (0.15, 0.10, 0.55, 0.20), (0.48, 0.18, 0.22, 0.12), (0.50, 0.25, 0.15, 0.10)]
#: Share of runs in capitals throughout, which follow the chain of their lower-case letters.
CAPITALS = 0.1
#: Share of a letter that does not depend on the one before it.
FREE = 0.1
#: Letters per hundred in European prose, as good as ``PRIOR`` letters of the corpus; ``LINK`` for
#: the letters that follow one letter. They matter in very small corpora only.
LETTERS = "a8 b2 c3 d4 e12 f2 g2 h4 i7 j1 k1 l5 m3 n7 o7 p3 q1 r6 s7 t8 u4 v1 w2 x1 y1 z1"
PRIOR, LINK = 2000, 20


def base_spans(text: Column) -> Column:
    """assign, access and hex spans of one text."""
    assign = find(text, "assign", ASSIGN, F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12)
    access = find(text, "access", ACCESS, F.contains(text, F.lit("AKIA")), lambda m: F.length(m) >= 18)
    hexes = find(text, "hex", HEX, text.rlike(HEX))
    return F.concat(assign, access, hexes)


def _encoding(m: Column) -> Column:
    """Name of the narrowest encoding that fits a run without its prefix."""
    plain = F.translate(m, "-_+/", "")
    return (
        F.when(m.rlike("[a-z]") & m.rlike("[A-Z]"), F.when(plain == m, "base62").otherwise("base64"))
        .when(plain == "", "base64")
        .when(plain.rlike("^[0-9]+$"), "dec")
        .when(~plain.rlike("[0-9]"), F.when(F.length(plain) < ALPHA, "letters").otherwise("alpha"))
        .when(plain.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(plain.rlike("^[A-Z2-7]+$"), "base32")
        .otherwise("base36")
    )


def _plain(m: Column, enc: Column) -> Column:
    """The run's symbols as written in the alphabet of its encoding."""
    bare = F.translate(m, "-_+/", "")
    return F.when(enc == "base64", F.translate(m, "-_", "+/")).when(enc.isin("base32", "base62"), bare).otherwise(F.lower(bare))


def _symbols(plain: Column, enc: Column) -> Column:
    """0-based places of the run's characters in the alphabet of its encoding."""
    alphabet = F.element_at(F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv]), enc)
    return F.transform(F.split(plain, ""), lambda c: F.call_function("instr", alphabet, c) - 1)


def _chi_squared(squares: Column, n: Column, k: Column) -> Column:
    """Normal score of chi-squared from the sum of squared counts (Wilson and Hilferty)."""
    df = k - 1.0
    chi = squares * k / n - n
    c = F.lit(2.0) / (F.lit(9.0) * df)
    return (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1.0 / 3.0)) - (F.lit(1.0) - c)) / F.sqrt(c)


def _tests(x: Column, plain: Column, alphabet: Column, cuts: Column, vowels: Column) -> Column:
    """Combined p-value of the battery for the symbols ``x`` of ``plain`` in ``alphabet``.

    ``cuts``: number of separators, null where they are no matter of chance; ``vowels``: number
    of vowels, null where they are not counted. Every sum is taken once.
    """
    pairs = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    upper = lambda v, k: v * 2 >= k
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    k = F.length(alphabet)
    counted = F.transform(F.split(alphabet, ""), lambda c: (F.length(plain) - F.length(F.replace(plain, c, F.lit("")))).cast("double"))
    sums = F.struct(
        F.size(x).cast("double").alias("n"),
        k.cast("double").alias("k"),
        total(F.transform(counted, lambda c: c * c)).alias("squares"),
        total(F.transform(x, lambda v: v.cast("double"))).alias("sum"),
        total(F.transform(x, lambda v: (v * v).cast("double"))).alias("sum2"),
        total(F.transform(pairs, lambda p: (p["a"] * p["b"]).cast("double"))).alias("lag"),
        (F.element_at(x, 1) + F.element_at(x, -1)).cast("double").alias("ends"),
        total(F.transform(x, lambda v: upper(v, k).cast("double"))).alias("high"),
        total(F.transform(pairs, lambda p: (upper(p["a"], k) != upper(p["b"], k)).cast("double"))).alias("turns"),
        cuts.alias("cuts"),
        vowels.alias("vowels"),
    )

    def combined(t):
        n, k, cuts, vowels = t["n"], t["k"], t["cuts"], t["vowels"]
        z1 = _chi_squared(t["squares"], n, k)
        z4 = F.when(cuts > 0, _chi_squared(t["squares"] + cuts * cuts, n + cuts, k + 1.0))
        z5 = (vowels - n * (5 / 26)) / F.sqrt(n * (5 / 26) * (21 / 26))
        mean_runs = F.lit(2.0) * t["high"] * (n - t["high"]) / n + 1.0
        var_runs = (mean_runs - 1.0) * (mean_runs - 2.0) / (n - 1.0)
        z2 = F.when(var_runs > 0, F.abs(t["turns"] + 1.0 - mean_runs) / F.sqrt(var_runs)).otherwise(F.lit(8.0))
        mean = t["sum"] / n
        var = t["sum2"] - n * mean * mean
        lag = t["lag"] - mean * (t["sum"] * 2 - t["ends"]) + (n - 1.0) * mean * mean
        z3 = F.when(var > 1e-9, F.abs(lag / var + 1.0 / n) * F.sqrt(n)).otherwise(F.lit(8.0))
        tests = F.lit(3.0) + F.when(cuts > 0, 1.0).otherwise(0.0) + F.when(vowels.isNotNull(), 1.0).otherwise(0.0)
        p = F.least(normal_tail(z1), normal_tail(z2) * 2, normal_tail(z3) * 2, normal_tail(z4), normal_tail(z5)) * tests
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))

    return F.when(F.size(x) > 1, let(sums, combined)).otherwise(0.0)


def letter_counts(docs: DataFrame, text_col: str = "text") -> dict[tuple[str, str], int]:
    """How often a letter follows another ('^': begins) in the corpus's distinct words.

    Words are the letters a-z (any case) of what stands between blanks, shorter than a run.
    At most 27 * 26 counts reach the driver.
    """
    words = docs.select(F.explode(F.split(text_or_empty(text_col), " ")).alias("w")).filter(F.length("w").between(1, 19)).distinct()
    plain = words.select(F.regexp_replace(F.lower("w"), "[^a-z]", "").alias("w")).filter("w <> ''").distinct()
    marked = F.concat(F.lit("^"), F.col("w"))
    pairs = plain.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.substring(marked, i, F.lit(2)))).alias("p"))
    return {(r["p"][0], r["p"][1]): r["count"] for r in pairs.groupBy("p").count().collect()}


def chain(counts: dict[tuple[str, str], int]) -> list[float]:
    """Log2 probabilities of the "structured" chain: 66 next states by 67 states before, in rows.

    A lower-case letter depends on the letter before it, an upper-case one on an upper-case one
    before it; other letters begin a word. Digits and separators are uniform in their class.
    """
    letters = STATES[:26]
    alone = {x[0]: int(x[1:]) * PRIOR / 100 for x in LETTERS.split()}
    for (_, y), n in counts.items():
        alone[y] += n
    every = sum(alone.values())
    share = {c: n / every for c, n in alone.items()}

    def follow(before: str) -> list[float]:
        row = sum(counts.get((before, c), 0) for c in letters)
        return [(1 - FREE) * (counts.get((before, c), 0) + LINK * share[c]) / (row + LINK) + FREE * share[c] for c in letters]

    begin, after = follow("^"), {c: follow(c) for c in letters}
    sizes, out = (26, 26, 10, 4), []
    for i in range(67):
        cls = 4 if i == 66 else 0 if i < 26 else 1 if i < 52 else 2 if i < 62 else 3
        before = STATES[i].lower() if i < 52 else None
        for j in range(66):
            to = 0 if j < 26 else 1 if j < 52 else 2 if j < 62 else 3
            own = 1 / sizes[to]
            if to == 0:
                own = (after[before] if before else begin)[j]
            elif to == 1:
                own = (after[before] if cls == 1 else begin)[j - 26]
            out.append(log2(TRANSITIONS[cls][to] * own))
    return out


def _candidates(text: Column) -> Column:
    """Runs: kind holds the encoding, m lacks the prefix."""
    runs = find(text, "random", RUN, text.rlike(RUN))
    bare = F.transform(runs, lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e"), F.regexp_replace(r["m"], PREFIX, "").alias("m")))
    return F.transform(bare, lambda r: F.struct(_encoding(r["m"]).alias("kind"), r["s"].alias("s"), r["e"].alias("e"), r["m"].alias("m")))


def _encoded_text(m: Column, enc: Column) -> Column:
    """Whether the run decodes to bytes that are valid UTF-8 without control characters.

    Random bytes do with probability under 0.5 a byte, a run of ``MIN_BITS`` bits with 1e-4.
    """
    padded = F.translate(m, "-_", "+/")
    padded = F.rpad(padded, (F.ceil(F.length(m) / 4) * 4).cast("int"), "=")
    data = F.when(enc.isin("base64", "base62"), F.try_to_binary(padded, F.lit("base64"))).when(enc == "hex", F.unhex(F.translate(m, "-_+/", "")))
    text = data.cast("string")
    return F.coalesce(F.is_valid_utf8(text) & text.rlike(r"^[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f]+$"), F.lit(False))


def _scored(runs: Column, model: list[float]) -> Column:
    """Runs (s, e) with their class and the whole bits that speak for random symbols, 0 at least."""
    alphabets = F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv])
    # split and cast of a literal become one array literal before execution
    table_ = F.split(F.lit(",".join(f"{x:.4f}" for x in model)), ",").cast("array<double>")

    def one(r):
        capitals = ~r["m"].rlike("[a-z]")
        states = F.transform(F.split(F.when(capitals, F.lower(r["m"])).otherwise(r["m"]), ""), lambda c: F.call_function("instr", F.lit(STATES), c) - 1)
        moves = lambda x: F.zip_with(F.concat(F.array(F.lit(66)), F.slice(x, F.lit(1), F.size(x) - 1)), x, lambda a, b: F.element_at(table_, a * 66 + b + 1))
        return F.struct(r["s"].alias("s"), r["e"].alias("e"), r["kind"].alias("kind"), r["m"].alias("m"), _plain(r["m"], r["kind"]).alias("plain"),
                        F.element_at(alphabets, r["kind"]).alias("alphabet"), let(states, lambda x: F.aggregate(moves(x), F.when(capitals, log2(CAPITALS)).otherwise(0.0), lambda a, v: a + v)).alias("text"))

    def judged(r):
        n, k = F.length(r["plain"]).cast("double"), F.length(r["alphabet"]).cast("double")
        separators = (F.length(r["m"]) - F.length(r["plain"])).cast("double")
        cuts = F.when((r["kind"] != "base64") & ~r["m"].rlike(GROUPS), separators)
        vowels = F.when(r["kind"].isin("letters", "alpha"), F.length(F.regexp_replace(r["plain"], "[^aeiou]", "")).cast("double"))
        p = let(_symbols(r["plain"], r["kind"]), lambda x: _tests(x, r["plain"], r["alphabet"], cuts, vowels))
        # uniform symbols, 8 bits for the place and kind of a separator, 4 for the encoding's name
        evidence = -(n * F.log2(k) + separators * 8 + 4) - r["text"]
        enough = (n * F.log2(k) >= MIN_BITS) & (evidence > 0)
        bits = F.when(enough, F.when((p > LEVEL) & ~_encoded_text(r["m"], r["kind"]), F.least(F.floor(evidence), F.lit(MOST_BITS)))).cast("int")
        cls = F.concat(r["kind"], F.lit("/"), F.floor(F.log2(F.greatest(n, F.lit(1.0)))).cast("string"))
        return F.struct(r["s"].alias("s"), r["e"].alias("e"), cls.alias("cls"), F.coalesce(bits, F.lit(0)).alias("bits"))

    return F.transform(F.transform(runs, one), judged)


def thresholds(runs: DataFrame, fdr: float = FDR) -> dict[str, int]:
    """Benjamini-Hochberg: the bits that a run of each class needs; ``runs`` has cls and bits.

    A run's p-value under "structured" is 2**-bits. The counts that reach the driver are bounded:
    eight encodings, one class for each power of two of a length, ``MOST_BITS`` + 1 values. A
    class of which nothing is reported has no entry.
    """
    classes: dict[str, dict[int, int]] = {}
    for r in runs.groupBy("cls", "bits").count().collect():
        classes.setdefault(r["cls"], {})[r["bits"]] = r["count"]
    return {name: cut for name, counts in classes.items() if (cut := least_bits(counts, fdr)) is not None}


def least_bits(counts: dict[int, int], fdr: float = FDR) -> int | None:
    """The fewest bits b such that m * 2**-b is at most ``fdr`` times the runs with b or more."""
    m, seen, cut = sum(counts.values()), 0, None
    for bits in sorted(counts, reverse=True):
        seen += counts[bits]
        if bits > 0 and m * 2.0**-bits <= fdr * seen:
            cut = bits
    return cut


def _reported(runs: Column, cuts: dict[str, int]) -> Column:
    cut = F.create_map(*[x for k, v in sorted(cuts.items()) for x in (F.lit(k), F.lit(v))]) if cuts else F.create_map().cast("map<string,int>")
    return F.filter(runs, lambda r: r["bits"] >= F.coalesce(F.element_at(cut, r["cls"]), F.lit(MOST_BITS + 1)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, base, extra), arrays of spans (kind, s, e).

    Null text is empty and has no span; repeated rows give equal rows; other columns, whatever
    their names, are not read; an empty table gives an empty result. Time grows with the length
    of a text, of a run and with the number of its spans.
    """
    model = chain(letter_counts(docs, text_col))
    src = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    held = materialise(
        src.select("id", base_spans(F.col("text")).alias("base"), _candidates(F.col("text")).alias("runs"))
        .select("id", "base", apart(F.col("runs"), F.col("base")).alias("runs"))
        .select("id", F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["s"].alias("s"), b["e"].alias("e"))).alias("base"), _scored(F.col("runs"), model).alias("runs"))
    )
    cuts = thresholds(held.select(F.explode("runs").alias("r")).select("r.cls", "r.bits"))
    extra = F.transform(_reported(F.col("runs"), cuts), lambda r: F.struct(F.lit("random").alias("kind"), r["s"].alias("s"), r["e"].alias("e")))
    return held.select("id", "base", extra.alias("extra"))


def redact(docs: DataFrame, mark: str = "<secret>", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the value of every secret replaced by ``mark``; nothing else changes.

    The documents are written once with their spans, so that no join is needed and the battery
    runs once: the cut-offs are the only state that crosses documents. Null text stays null,
    repeated rows stay, and so do columns of any name.
    """
    base, runs = free_name(docs, "base_spans"), free_name(docs, "run_spans")
    model = chain(letter_counts(docs, text_col))
    text = text_or_empty(text_col)
    own = lambda b: F.when(b["kind"] == "assign", F.length(F.regexp_extract(b["m"], ASSIGN, 2))).otherwise(b["e"] - b["s"])
    seen = docs.withColumn(base, base_spans(text)).withColumn(runs, _candidates(text))
    seen = seen.withColumn(runs, _scored(apart(F.col(runs), F.col(base)), model))
    held = materialise(seen.withColumn(base, F.transform(base, lambda b: F.struct((b["e"] - own(b)).alias("s"), b["e"].alias("e")))))
    cuts = thresholds(held.select(F.explode(runs).alias("r")).select("r.cls", "r.bits"))
    spans = F.concat(F.col(base), F.transform(_reported(F.col(runs), cuts), lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e"))))
    return held.withColumn(text_col, F.when(F.size(spans) > 0, replaced(text, spans, mark)).otherwise(F.col(text_col))).drop(base, runs)


def op9_secret_scan(spark, sf_dir):
    """Contract query over all ``documents``."""
    rows = scan(table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"),
        *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(ordered(F.col("base"), KINDS), 256).alias("base_sha256"),
        ordered(F.concat("base", "extra"), KINDS).alias("spans"),
    )
