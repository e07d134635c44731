"""Operator 2: secret scans. Native column expressions; nothing is shuffled but the small training set.

Base spans come from three patterns: ``assign`` (a key word, a sign and a value of 6 or more
characters), ``access`` (AKIA and capitals or digits, 20 or more characters) and ``hex`` (24 or more
characters). Matches are leftmost and do not overlap within a kind; a match that is too short is
dropped after it was consumed.

Further spans, ``random``, come from two character Markov models of first order, one of
random strings and one of ordinary strings, trained from labelled samples (``fit``): random ones made
by rule, ordinary ones composed of words of the corpus and of programs, and numbers, dates, UUIDs, phone numbers,
versions, codes, alphabets, repeated characters and rules. Base spans become spaces first; in each run of
``LEAST_RUN`` or more key characters that is left, each segment of at least so many
characters whose log-likelihood ratio of the two models is over a threshold (in nats; ``fit`` calibrates it on
held-out strings of both kinds, ``THRESHOLD`` is the default) is one: ordinary characters before or after a key
don't weigh against it. A segment ends where the ratio has fallen by the threshold from its best, so
a run can hold several. It is widened to the separators around it, or to the ends of the piece.

Spans count code points, the end is exclusive. Nulls: a null text is empty and has no spans.
Repeated rows are scanned as often as they come; empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.shared import computed_once, whole_text

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the run goes on to its end, so this drops what is too short
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_=-]{16,}"
LEAST_VALUE = 6
LEAST_RUN = 16
SEPARATORS = "+/_=-"

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SAMPLES = 4_000
#: Words of the corpus, at most, of which ordinary strings are composed, and held-out ordinary strings.
WORDS, HELD_OUT = 2_000, 4_000
FALSE_RATE, MISS_RATE, SHORT = 0.0005, 0.02, 18
THRESHOLD = 15.0
#: Parts of the identifiers of programs.
PARTS = """
account action address array async author batch block buffer button cache call check class click client close code
color column command commit config connect content context control count create current customer data date debug
default delete detail device document domain driver email enable encode engine error event export factory feature
field file filter format frame function generate group handle handler header height history image import index
input insert instance interface internal invalid item label language layout length level library limit list load
local location manager map margin match max member memory message method model module name network node number
object offset option order output package page parent parse password path pattern payment position prefix process
product profile project property provider query range read record register remove render report request resource
response result return role route row sample schema screen search select server service session setting shape size
sort source stack start state status step stop storage string style system table target task template test text
thread time title token total transaction type update user validate value vector version view visible width window
write zone
""".split()


def corpus_words(docs: DataFrame, most: int = WORDS) -> list[str]:
    """Words of 3 to 14 letters of a-z that occur at least twice, ``most`` by the order of their hash."""
    words = docs.select(F.explode(F.split(F.lower(F.translate(whole_text(), "\n\t.,;:!?", " " * 8)), " ")).alias("word")).filter(F.col("word").rlike("^[a-z]{3,14}$"))
    often = words.groupBy("word").agg(F.count("*").alias("n")).filter("n > 1")
    return [r["word"] for r in often.orderBy(F.xxhash64("word"), "word").limit(most).collect()]


def labelled_samples(spark: SparkSession, n: int = SAMPLES, words: list[str] | None = None, first: int = 0) -> DataFrame:
    """Strings of key characters with label 1 (random) or 0 (ordinary), ``n`` of each, by rule.

    Half of the words in the ordinary ones are ``words``, if there are any; ``first`` is the number of the first string.
    """
    sources = [F.split(F.lit(" ".join(w)), " ") for w in (PARTS, words or PARTS)]
    sizes = [len(PARTS), len(words or PARTS)]
    drawn = lambda k, s: F.get(sources[s], F.pmod(F.xxhash64("id", k), F.lit(sizes[s])).cast("int"))
    word = lambda k: F.when(F.pmod(F.floor(F.col("id") / 8), F.lit(2)) == 0, drawn(k, 0)).otherwise(drawn(k, 1))
    # drawn in a projection of their own: each use in the kinds below would otherwise hold the whole list of words in the plan
    five = F.transform(F.sequence(F.lit(0), F.lit(4)), word)
    ids = spark.range(first, first + n).select("id", computed_once(five).alias("_words"), computed_once(F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)).alias("_digest"))
    words, digest = [F.get("_words", F.lit(k)) for k in range(5)], F.col("_digest")
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    mixed = F.regexp_replace(base64, "[+/]", "")  # hex strings of a length that counts are a base kind
    random = ids.select(F.when(F.col("id") % 4 == 0, mixed).when(F.col("id") % 4 == 1, F.upper(F.conv(F.substring(digest, 1, 15), 16, 36))).when(F.col("id") % 4 == 2, F.translate(base64, "+/", "-_")).otherwise(base64).alias("text"), F.lit(1).alias("label"))
    snake, camel = F.concat_ws("_", *words), F.concat(words[0], *[F.initcap(w) for w in words[1:]])
    plain, path = F.concat(*words), F.concat_ws("/", *words[:4])
    kebab, upper = F.concat(F.concat_ws("-", *words[:4]), (F.col("id") % 100).cast("string")), F.upper(F.concat_ws("_", *words[:4]))
    digits = F.translate(digest, "abcdef", "012345")
    part = lambda a, n: F.substring(digits, a, n)
    moment = F.date_add(F.lit("1990-01-01").cast("date"), F.pmod(F.xxhash64("id"), F.lit(16_000)).cast("int"))
    clock = F.date_format(F.timestamp_seconds(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(86_400))), "HHmmss")
    date, dated = F.date_format(moment, "yyyy-MM-dd"), F.date_format(moment, "yyyyMMdd")
    stamp = F.concat(date, F.lit("T"), F.concat_ws("-", F.substring(clock, 1, 2), F.substring(clock, 3, 2), F.substring(clock, 5, 2)))
    phone = F.concat(F.lit("+"), part(1, 2), F.lit("-"), part(3, 3), F.lit("-"), part(6, 3), F.lit("-"), part(9, 4))
    uuid = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    turn = F.floor(F.col("id") / 22)  # free of the kind
    same = F.repeat(F.substring(F.lit(ALPHABET), F.pmod(turn, F.lit(len(ALPHABET))).cast("int") + 1, F.lit(1)), 24)
    rule = F.repeat(F.substring(F.lit(SEPARATORS), F.pmod(turn, F.lit(len(SEPARATORS))).cast("int") + 1, F.lit(1)), 40)
    row = F.substring(F.repeat(F.when(turn % 3 == 0, F.lit("abcdefghijklmnopqrstuvwxyz")).when(turn % 3 == 1, F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(F.lit("0123456789")), 3), F.pmod(turn, F.lit(20)).cast("int") + 1, F.lit(26))
    image, version = F.concat(F.upper(words[0]), F.lit("_"), dated, F.lit("_"), clock), F.concat(words[0], F.lit("-v"), part(1, 1), F.lit("-"), part(2, 2), F.lit("-"), part(4, 4), F.lit("-"), words[1])
    code, table = F.concat(F.upper(F.substring(words[0], 1, 3)), F.lit("-"), part(1, 6), F.lit("-"), F.upper(F.substring(words[1], 1, 2)), part(7, 6)), F.repeat(F.concat(F.lit("-"), F.lit("="), F.lit("_"), F.lit("+")), 6)
    named = F.concat_ws("_", words[0], words[1], part(1, 8), dated)
    short = F.concat(F.upper(F.substring(words[0], 1, 3)), *[F.initcap(w) for w in words[1:4]])
    kinds = [snake, camel, path, kebab, upper, plain, plain, short, F.substring(digits, 1, 24), stamp, F.concat(dated, clock, part(1, 4)), phone, uuid, same, row, image, version, code, named, path, table, rule]
    kind, made = F.pmod(F.col("id"), F.lit(len(kinds))), kinds[-1]
    for k, text in enumerate(kinds[:-1]):
        made = F.when(kind == k, text).otherwise(made)
    ordinary = ids.select(made.alias("text"), F.lit(0).alias("label"))
    return random.union(ordinary)


def _codes(text: Column) -> Column:
    """Positions of the characters in ALPHABET, 0 for others."""
    return F.transform(F.split(text, ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.instr(F.lit(ALPHABET), c)))


def train(samples: DataFrame) -> list[float]:
    """Log ratio of the transition probabilities for each pair of codes, row after row.

    Pairs are counted in Spark; at most 2 * (len(ALPHABET) + 1) ** 2 counts reach the driver.
    """
    wide = len(ALPHABET) + 1
    coded = samples.filter("text is not null and label in (0, 1)").select("label", _codes(F.col("text")).alias("codes")).filter(F.size("codes") > 1)
    pairs = coded.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.size("codes") - 1), lambda i: F.get("codes", i - 1) * wide + F.get("codes", i))).alias("pair"))
    counts = [[0.5] * wide * wide, [0.5] * wide * wide]  # additive smoothing
    for row in pairs.groupBy("label", "pair").count().collect():
        counts[row["label"]][row["pair"]] += row["count"]
    sums = [[sum(c[k * wide : (k + 1) * wide]) for k in range(wide)] for c in counts]
    return [round(math.log(counts[1][p] / sums[1][p // wide]) - math.log(counts[0][p] / sums[0][p // wide]), 4) for p in range(wide * wide)]


def best_segment(text: str, model: list[float]) -> float:
    """The largest log ratio of a segment of LEAST_RUN characters or more of a string; minus infinity if it is shorter."""
    wide = len(ALPHABET) + 1
    codes = [ALPHABET.find(c) + 1 for c in text]
    sums = [0.0]
    for a, b in zip(codes, codes[1:]):
        sums.append(sums[-1] + model[a * wide + b])
    best = low = float("inf")
    best = -best
    for k in range(LEAST_RUN - 1, len(sums)):
        low = min(low, sums[k - LEAST_RUN + 1])
        best = max(best, sums[k] - low)
    return best


def fit(spark: SparkSession, docs: DataFrame) -> tuple[list[float], float]:
    """The model and its threshold, from ``HELD_OUT`` strings of each label that weren't trained on.

    The threshold is the ratio that ``FALSE_RATE`` of the ordinary strings pass; if the first ``SHORT`` characters of all random ones
    but ``MISS_RATE`` pass a higher one, it lies midway. Raises if it isn't positive: the models then tell nothing apart.
    """
    words = corpus_words(docs)
    model = train(labelled_samples(spark, words=words))
    held = labelled_samples(spark, HELD_OUT, words, first=SAMPLES).collect()
    ordinary = sorted((best_segment(r["text"], model) for r in held if r["label"] == 0), reverse=True)
    random = sorted(best_segment(r["text"][:SHORT], model) for r in held if r["label"] == 1 and len(r["text"]) >= SHORT)
    high = ordinary[int(FALSE_RATE * len(ordinary))]
    low = random[int(MISS_RATE * len(random))] if random else high
    threshold = round(max(high, (high + low) / 2), 4)
    if threshold <= 0:
        raise ValueError(f"the models tell nothing apart: {FALSE_RATE} of the held-out ordinary strings score over {high}, {MISS_RATE} of the random ones under {low}")
    return model, threshold


def log_ratio(text: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a string: random against ordinary."""
    wide = len(ALPHABET) + 1
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")  # folded to a literal
    step = lambda s, c: F.struct(c.alias("last"), F.when(s["last"] < 0, F.lit(0.0)).otherwise(s["sum"] + F.get(table, s["last"] * wide + c)).alias("sum"))
    return F.aggregate(_codes(text), F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")), step, lambda s: s["sum"])


def _steps(codes: Column, model: list[float]) -> Column:
    """Log ratio of each transition, an array one shorter than the codes."""
    wide = len(ALPHABET) + 1
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    codes = F.filter(codes, lambda c: c.isNotNull())
    return F.zip_with(F.slice(codes, 1, F.greatest(F.lit(0), F.size(codes) - 1)), F.slice(codes, 2, F.greatest(F.lit(0), F.size(codes) - 1)), lambda a, b: F.get(table, a * wide + b))


def _bound(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _segments(steps: Column, threshold: float) -> Column:
    """Structs (a, b) of the segments of LEAST_RUN characters or more that score over the threshold, from one scan.

    ``sum`` is the ratio since ``base``, ``lag`` the same LEAST_RUN - 1 transitions ago and ``low`` the
    least ``lag``, so ``sum - low`` is the best score of a segment that ends here and is long enough.
    """
    back = LEAST_RUN - 1
    late = F.slice(F.concat(F.array_repeat(F.lit(0.0), back), steps), 1, F.size(steps))
    pairs = F.zip_with(steps, late, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    zero, none = F.lit(0.0), F.array().cast("array<struct<a:int,b:int>>")
    state = lambda base, n, sum, lag, low, low_at, peak, a, b, out: F.struct(*[c.alias(k) for k, c in {"base": base, "n": n, "sum": sum, "lag": lag, "low": low, "low_at": low_at, "peak": peak, "a": a, "b": b, "out": out}.items()])
    fresh = lambda base, out: state(base, F.lit(0), zero, zero, zero, base, zero, F.lit(0), F.lit(0), out)
    found = lambda s: F.when(s["peak"] > threshold, F.concat(s["out"], F.array(F.struct(s["a"].alias("a"), s["b"].alias("b"))))).otherwise(s["out"])

    def moved(s: Column, x: Column) -> Column:
        n = s["n"] + 1
        lag = F.when(n > back, s["lag"] + x["y"]).otherwise(zero)
        return F.struct(n.alias("n"), (s["sum"] + x["x"]).alias("sum"), lag.alias("lag"), (lag < s["low"]).alias("lower"))

    def step(s: Column, x: Column) -> Column:
        def scored(t: Column) -> Column:
            low, low_at = F.when(t["lower"], t["lag"]).otherwise(s["low"]), F.when(t["lower"], s["base"] + t["n"] - back).otherwise(s["low_at"])
            return F.struct(t["n"].alias("n"), t["sum"].alias("sum"), t["lag"].alias("lag"), low.alias("low"), low_at.alias("low_at"), F.when(t["n"] >= back, t["sum"] - low).otherwise(zero).alias("score"))

        def done(t: Column) -> Column:
            at = s["base"] + t["n"]
            best = (t["n"] >= back) & (t["score"] > s["peak"])
            ended = (s["peak"] > threshold) & (s["peak"] - t["score"] > threshold)
            on = state(s["base"], t["n"], t["sum"], t["lag"], t["low"], t["low_at"], F.when(best, t["score"]).otherwise(s["peak"]), F.when(best, t["low_at"]).otherwise(s["a"]), F.when(best, at + 1).otherwise(s["b"]), s["out"])
            return F.when(ended, fresh(at, found(s))).otherwise(on)

        return _bound(_bound(moved(s, x), scored), done)

    return F.aggregate(pairs, fresh(F.lit(0), none), step, found)


def _random(piece: Column, model: list[float], threshold: float) -> Column:
    """Spans of the segments in a struct (start, text, k), widened to the separators around them."""

    def span(text: Column, start: Column, k: Column, s: Column) -> Column:
        plain = F.translate(text, SEPARATORS, " " * len(SEPARATORS))
        left = F.length(F.substring_index(F.substring(plain, F.lit(1), s["a"]), " ", -1))
        right = F.length(F.substring_index(F.substring(plain, s["b"] + 1, F.length(plain)), " ", 1))
        return F.struct((start + s["a"] - left).alias("start"), F.lit(3).alias("kind"), (start + s["b"] + right).alias("end"), k.alias("k"))

    segments = _bound(_bound(_codes(piece["text"]), lambda c: _steps(c, model)), lambda x: _segments(x, threshold))
    return F.transform(segments, lambda s: span(piece["text"], piece["start"], piece["k"], s))


def _found(pattern: str, groups: tuple[int, ...], prefix: str) -> list[Column]:
    """Per match of ``pattern``: what stands between it and the match before, and the groups asked for.

    ``\\G`` ties each attempt to the end of the last match: a failing attempt costs one look at the
    text, not one for each position.
    """
    whole = rf"(?s)\G(.*?)({pattern})"
    some = F.col("_text").rlike(pattern)
    none = F.array().cast("array<string>")
    return [F.when(some, F.regexp_extract_all("_text", F.lit(whole), F.lit(g))).otherwise(none).alias(f"{prefix}{g}") for g in (1, *groups)]


def _spans(kind: int, prefix: str, value: str | None = None) -> Column:
    """Structs (start, kind, end, match, ok) of the matches."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))  # appending to an array would copy it value by value

    def step(s: Column, k: Column) -> Column:
        start = s["at"] + F.length(F.get(f"{prefix}1", k))
        return F.struct((start + F.length(F.get(f"{prefix}2", k))).alias("at"), F.concat(s["out"], start.cast("string"), F.lit(" ")).alias("out"))

    size = F.size(f"{prefix}1")
    positions = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.split(F.aggregate(positions, begin, step, lambda s: s["out"]), " ")

    def span(starts: Column, k: Column) -> Column:
        start = F.get(starts, k).cast("int")
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(F.get(f"{prefix}2", k))).alias("end"), k.alias("k"))

    wide = lambda k: F.length(F.get(value, k)) >= LEAST_VALUE if value else F.lit(True)
    return _bound(starts, lambda x: F.transform(F.filter(positions, wide), lambda k: span(x, k)))


def with_spans(docs: DataFrame, model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``_base`` and ``_spans``: sorted arrays of (start, kind, end, k), kind an index of KINDS.

    Columns of these names are replaced; the others travel in one struct, so no name can clash.
    """
    own = F.struct(F.lit(0).alias("_none"), *[F.col(f"`{c}`") for c in docs.columns if c not in ("_base", "_spans")]).alias("_own")
    step = docs.select(own, whole_text().alias("_text"))
    step = step.select("*", *_found(ASSIGN, (2, 3), "_a"), *_found(ACCESS, (2,), "_k"), *_found(HEX, (2,), "_h"))
    step = step.select("_own", "_text", F.sort_array(F.concat(_spans(0, "_a", "_a3"), _spans(1, "_k"), _spans(2, "_h"))).alias("_base"))
    step = step.select("_own", "_base", computed_once(_masked()).alias("_text"))
    step = step.select("_own", "_base", *_found(RUN, (2,), "_r"))
    step = step.select("_own", "_base", F.zip_with(_spans(3, "_r"), "_r2", lambda r, t: F.struct(r["start"].alias("start"), t.alias("text"), r["k"].alias("k"))).alias("_pieces"))
    random = F.flatten(F.transform("_pieces", lambda p: _random(p, model, threshold)))
    return step.select("_own", "_base", F.sort_array(F.concat("_base", random)).alias("_spans")).select(*[F.col(f"_own.`{c}`") for c in docs.columns if c not in ("_base", "_spans")], "_base", "_spans")


def _masked() -> Column:
    """The text with spaces for the characters of base spans."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        start = F.greatest(s["at"], x["start"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], F.substring(F.col("_text"), s["at"] + 1, start - s["at"]), F.repeat(F.lit(" "), F.greatest(F.lit(0), x["end"] - start))).alias("out"))

    cut = F.aggregate("_base", begin, step, lambda s: F.concat(s["out"], F.substring(F.col("_text"), s["at"] + 1, F.length("_text"))))
    return F.when(F.size("_base") > 0, cut).otherwise(F.col("_text"))


def _joined(spans: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans and n_random of every document."""
    rows = with_spans(docs.select("doc_id", "text"), model, threshold)
    count = lambda k, name: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("long").alias(name)
    return rows.select("doc_id", *[count(k, f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(_joined("_base"), 256).alias("base_sha256"), _joined("_spans").alias("spans"))


def redact(docs: DataFrame, model: list[float], threshold: float = THRESHOLD, mask: str = "[secret]") -> DataFrame:
    """The documents with every span replaced by ``mask``; a column n_chars follows the new text.

    Documents without spans stay as they are, null texts too.
    """
    rows = with_spans(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "text"), model, threshold)
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        inside = x["end"] <= s["at"]
        between = F.substring("text", s["at"] + 1, F.greatest(F.lit(0), x["start"] - s["at"]))
        return F.when(inside, s).otherwise(F.struct(x["end"].alias("at"), F.concat(s["out"], between, F.lit(mask)).alias("out")))

    cut = F.aggregate("_spans", begin, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    rows = rows.select("_doc", F.when(F.size("_spans") > 0, cut).otherwise(F.col("text")).alias("_new"), (F.size("_spans") > 0).alias("_cut"))
    new = {"text": F.col("_new"), "n_chars": F.when(F.col("_cut"), F.length("_new").cast("long")).otherwise(F.col("_doc.n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"_doc.`{c}`") for c in docs.columns])
