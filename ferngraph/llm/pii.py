"""Personal data: base patterns, and contextual extraction bootstrapped from them.

Base entities (email, ip, card, phone) are found by pattern and check; values
assigned to a name like token or password are seeds of a fifth kind, secret. All
seed a search for identifiers that no pattern describes: every identifier-like token
or run of number tokens (with several digits, or an @) is an instance, the words
around it are its lexical patterns, and a number's own shape is the pattern to
fall back on where words don't repeat. The corpus-wide table of (pattern, instance) is a
bipartite graph. Spark scores it in rounds: a pattern is as reliable for a kind
as the share of its instances believed to be of that kind, damped where few
support it; an instance is as likely of a kind as its patterns together make it.
Nothing confirms itself: what an instance tells a pattern leaves out what that
pattern told the instance, and the other way round. Seeds stay certain. Instances
in the slots of patterns that end above the threshold are added as spans of the
pattern's kind; a shape has to be nearly certain, and never brings back a number
that fails its kind's own check.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferngraph.llm.common import discard, lean, ship, small, workdir, written

#: In the order that breaks ties of position.
KINDS = ("email", "ip", "card", "phone")
#: A kind of the operator's own, which base spans and `spans` of the digest don't have.
SECRET = len(KINDS)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match never begins within a run of digits: what fails at its start fails there too.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_DIGITS = re.compile(r"[0-9]+")
_LETTER = re.compile(r"[^\W\d_]")
#: Digits in a token, or in a run of them, that make it identifier-like.
DIGITS = 6
#: Reliability that a pattern needs at least if it is the shape of a number
#: alone; belief from which an instance speaks for its other patterns.
SHAPE_RELIABILITY, BELIEF = 0.9, 0.25
#: Longer words and shapes stand in patterns by their digests.
LONGEST = 40
#: A pattern's window before a slot: so many words are looked at until one has a letter.
MARKS = 4
#: Values of a credential's name: quoted, or a word with letters and digits.
_ASSIGNED = re.compile(r"""[=:][ \t]*(?:(["'])([^"'\s]{8,})\1|([A-Za-z0-9_./+~-]{8,}={0,2})(?![^\s"'`,;)\]}>]))""")
_NAMED = re.compile(r"""(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|(?:access|private|auth)[_-]?key|credentials?)$""")
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
_PLAIN_NUMBER = re.compile(r"[0-9+() .-]+")
_NUMBER = re.compile(r"[(+]*[0-9][0-9().-]*")
_GAP = re.compile(r"\s")
_NO_DIGITS = str.maketrans("0123456789", "ghijklmnop")  # so that patterns, which take numbers as alike, keep digests apart
_EDGE = "\"'`.,;:!?()[]{}<>|*#$%&="
SPAN = "struct<kind: int, start: int, end: int>"
#: Texts without a match hold nothing that is looked for.
MAY = r"""[0-9@]|[=:][ \t]*["']"""  # a value without quotes has a digit


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if k % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by start, then kind; of each kind
    the leftmost matches that don't overlap, without those that fail its check."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        s = at
        while s > done and text[s - 1] in _LOCAL:
            s -= 1
        if s < at and (m := _DOMAIN.match(text, at)):
            out.append((0, s, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(x) <= 3 and int(x or 0) <= 255 for x in (y.lstrip("0") for y in m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = _NOT_DIGIT.sub("", m[0])
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], x[0], x[2]))


def _name_before(text: str, at: int) -> str:
    """The name in front of a sign of assignment, without quotes and blanks."""
    e = at
    while e > 0 and text[e - 1] in " \t":
        e -= 1
    if e > 0 and text[e - 1] in "\"'":
        e -= 1
    s = e
    while s > 0 and text[s - 1] in _NAME:
        s -= 1
    return text[s:e]


def secret_spans(text: str) -> list[tuple[int, int, int]]:
    """Values that are assigned to a name of a credential: in quotes, or a word
    of letters and digits."""
    out = []
    for m in _ASSIGNED.finditer(text):
        k = 2 if m[2] is not None else 3
        if (k == 2 or (_DIGIT.search(m[3]) and _LETTER.search(m[3]))) and _NAMED.search(_name_before(text, m.start())):
            out.append((SECRET, m.start(k), m.end(k)))
    return out


def failed_kind(text: str) -> int:
    """The kind whose pattern a slot is, but whose check it fails; -1 if none."""
    digits = _NOT_DIGIT.sub("", text)
    if _CARD.fullmatch(text) and len(digits) >= 12 and not (len(digits) <= 19 and luhn(digits)):
        return 2
    if _PHONE.fullmatch(text) and not 9 <= len(digits) <= 15:
        return 3
    if _IP.fullmatch(text) and not any(k == 1 for k, _, _ in base_spans(text)):
        return 1
    return -1


def _raw_tokens(text: str) -> Iterator[tuple[int, int]]:
    """White-space tokens with a digit or an @."""
    done, n = 0, len(text)
    for m in re.finditer(r"[0-9@]", text):
        if m.start() < done:
            continue
        s = m.start()
        while s > done and not text[s - 1].isspace():
            s -= 1
        gap = _GAP.search(text, m.end())
        e = done = gap.start() if gap else n
        yield s, e


def _trimmed(text: str, s: int, e: int) -> tuple[int, int]:
    """Without marks around, but with a bracket whose other half lies inside."""
    first, last = s, e
    while s < e and text[s] in _EDGE:
        s += 1
    while e > s and text[e - 1] in _EDGE:
        e -= 1
    if s > first and text[s - 1] == "(" and 0 <= text.find(")", s, e) < (text.find("(", s, e) + 1 or e + 1):
        s -= 1
    if e < last and text[e] == ")" and text.rfind("(", s, e) > text.rfind(")", s, e):
        e += 1
    return s, e


def _instances(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Identifier-like slots outside the spans, without marks around them: tokens,
    and longest runs of number tokens one space apart."""
    by_start, k = sorted((s, e) for _, s, e in spans), 0
    run: tuple[int, int, bool] | None = None  # start, end, whether of numbers
    for first, last in [*_raw_tokens(text), (-1, -1)]:
        s, e = _trimmed(text, first, last) if first >= 0 else (-1, -1)
        while k < len(by_start) and by_start[k][1] <= s:
            k += 1
        free = s < e and (k == len(by_start) or by_start[k][0] >= e)
        number = free and _NUMBER.fullmatch(text, s, e) is not None
        if run and number and run[2] and first == run[1] + 1 and text[first - 1] == " " and text[first] in "(0123456789" and text[run[1] - 1] in ")0123456789":
            run = (run[0], last, True)
            continue
        if run:
            a, b = _trimmed(text, run[0], run[1])
            if sum(c in "0123456789" for c in text[a:b]) >= DIGITS or "@" in text[a:b]:
                yield a, b
        run = (first, last, number) if free else None


def _word_before(text: str, at: int) -> tuple[str, int]:
    e = at
    while e > 0 and text[e - 1].isspace():
        e -= 1
    s = e
    while s > 0 and not text[s - 1].isspace():
        s -= 1
    return _short(text[s:e].lower()), s


def _short(word: str) -> str:
    """A word, or a digest with a letter in front that stands for a long one."""
    return word if len(word) <= LONGEST else "w" + hashlib.blake2b(_DIGITS.sub("9", word).encode(), digest_size=12).hexdigest().translate(_NO_DIGITS)


def _word_after(text: str, at: int) -> str:
    s, n = at, len(text)
    while s < n and text[s].isspace():
        s += 1
    e = gap.start() if (gap := _GAP.search(text, s)) else n
    return _short(text[s:e].lower())


def _words_before(text: str, at: int, words: int) -> str | None:
    """So many words before a place, and more until one has a letter, MARKS at most."""
    out: list[str] = []
    while len(out) < MARKS and (len(out) < words or not any(map(_LETTER.search, out))):
        word, at = _word_before(text, at)
        if not word:
            break
        out.insert(0, word)
    return " ".join(out) if any(map(_LETTER.search, out)) else None


def contexts(text: str, s: int, e: int) -> list[str]:
    """Lexical patterns of a slot: two words before, one before and one after,
    with numbers alike; of a number also its shape."""
    two, one, after = _words_before(text, s, 2), _words_before(text, s, 1), _word_after(text, e)
    out = [_DIGITS.sub("9", x) for x in (two and f"{two} _", one and f"{one} _ {after}") if x]
    return [*out, "#" + _short(_DIGIT.sub("9", text[s:e]))] if _PLAIN_NUMBER.fullmatch(text, s, e) else out


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    slots_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("failed", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))
    listed = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]
    for batch in batches:
        rows: tuple[list, list, list] = ([], [], [])
        for text in batch.column(1).to_pylist():
            spans, secrets = (base_spans(text), secret_spans(text)) if text else ([], [])
            slots = [*spans, *secrets]
            if text:
                slots += [(-1, s, e) for s, e in _instances(text, slots)]
            rows[0].append(listed(spans))
            rows[1].append(listed(secrets))
            rows[2].append([{"kind": k, "start": s, "end": e, "failed": failed_kind(text[s:e]) if k < 0 else -1, "instance": hashlib.blake2b(text[s:e].lower().encode(), digest_size=12).hexdigest(), "patterns": contexts(text, s, e)} for k, s, e in slots])
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows, (spans_type, spans_type, slots_type))], ["row", "spans", "secrets", "slots"])


def score_graph(edges: DataFrame, work: str, rounds: int = 3, damping: float = 3.0) -> DataFrame:
    """(pattern, kind, reliability) from edges (pattern, instance, seed):
    seed is the instance's kind, -1 if unknown. An instance that is a seed
    somewhere is one everywhere.

    A pattern tells an instance its support without what the instance gave, over
    its other instances; an instance gives a pattern the belief that its other
    patterns make, 1 - prod(1 - told), if that reaches BELIEF. Edges of common
    patterns and instances are summed up before they are shuffled; the other
    side of a join is broadcast if its counted rows are few, else Spark splits
    what is skewed."""
    seeds = edges.where("seed >= 0").select("instance", F.col("seed").alias("kind")).distinct()
    seeds = written(seeds, f"{work}/seeds")
    n_seeds = seeds.count()
    links = edges.select("pattern", "instance").distinct()
    links = written(links.join(small(seeds.select("instance").distinct().withColumn("sure", F.lit(True)), n_seeds), "instance", "left"), f"{work}/links")
    degree = links.groupBy("pattern").agg(F.count("*").alias("degree"))
    first = written(links.where("sure").join(small(seeds, n_seeds), "instance").groupBy("pattern", "kind").agg(F.count("*").cast("double").alias("support")), f"{work}/first")
    open_ = links.where("sure is null").select("pattern", "instance")
    gave, patterns = None, None
    for k in range(rounds):
        support = first if gave is None else first.unionByName(gave.groupBy("pattern", "kind").agg(F.sum("gave").alias("support"))).groupBy("pattern", "kind").agg(F.sum("support").alias("support"))
        patterns = written(support.join(degree, "pattern"), f"{work}/patterns-{k}")
        if k + 1 == rounds:
            break
        told = open_.join(small(patterns, patterns.count()), "pattern")
        if gave is not None:
            told = told.join(gave, ["pattern", "instance", "kind"], "left")
        own = F.coalesce("gave", F.lit(0.0)) if gave is not None else F.lit(0.0)
        says = F.log1p(-F.least((F.col("support") - own) / (F.col("degree") - 1 + damping), F.lit(0.999)))
        told = written(told.select("pattern", "instance", "kind", says.alias("says")).where("says < -1e-12"), f"{work}/told-{k}")
        whole = told.groupBy("instance", "kind").agg(F.sum("says").alias("all"), F.count("*").alias("n")).where(F.col("n") > 1)
        whole = written(whole.drop("n"), f"{work}/whole-{k}")
        gave = told.join(small(whole, whole.count()), ["instance", "kind"]).select("pattern", "instance", "kind", (1 - F.exp(F.col("all") - F.col("says"))).alias("gave"))
        gave = written(gave.where(F.col("gave") >= BELIEF), f"{work}/gave-{k}")
    return patterns.select("pattern", "kind", (F.col("support") / (F.col("degree") + damping)).alias("reliability"))


def bootstrap(rows: DataFrame, reliability: float, rounds: int) -> DataFrame:
    """(row, base, spans) of rows (row, text); row is a key of any type."""
    work = workdir(rows.sparkSession, "pii")
    kind = rows.schema["row"].dataType.simpleString()
    schema = f"row {kind}, spans array<{SPAN}>, secrets array<{SPAN}>, slots array<struct<kind: int, start: int, end: int, failed: int, instance: string, patterns: array<string>>>"
    found = written(rows.mapInArrow(lean(_found), schema), f"{work}/found")
    slots = found.where(F.size("slots") > 0).select("row", F.explode("slots").alias("s")).select("row", "s.*")
    places = slots.select("instance", "kind", F.explode("patterns").alias("pattern"))
    edges = written(places.groupBy("pattern", "instance").agg(F.max("kind").alias("seed")), f"{work}/edges")
    least = F.when(F.col("pattern").startswith("#"), F.lit(max(reliability, SHAPE_RELIABILITY))).otherwise(F.lit(reliability))
    good = score_graph(edges, f"{work}/graph", rounds).where(F.col("reliability") >= least)
    good = good.groupBy("pattern").agg(F.max(F.struct("reliability", -F.col("kind"))).alias("m")).select("pattern", (-F.col("m.col2")).alias("of"), F.col("m.reliability").alias("reliability"))
    good = written(good, f"{work}/good")
    discard(rows.sparkSession, f"{work}/edges", f"{work}/graph")
    new = slots.where("kind < 0").select("row", "start", "end", "failed", F.explode("patterns").alias("pattern")).join(small(good, good.count()), "pattern")
    new = new.where(~(F.col("pattern").startswith("#") & (F.col("failed") == F.col("of"))))
    new = new.groupBy("row", "start", "end").agg(F.max(F.struct("reliability", -F.col("of"))).alias("m"))
    new = new.select("row", F.struct((-F.col("m.col2")).cast("int").alias("kind"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")).alias("s"))
    added = new.groupBy("row").agg(F.collect_list("s").alias("added"))
    every = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    every = F.transform(every, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    out = found.select("row", F.col("spans").alias("base"), "secrets").join(added.withColumnRenamed("row", "row2"), F.col("row").eqNullSafe(F.col("row2")), "left")
    return out.select("row", "base", F.concat("base", "secrets", F.coalesce("added", F.array().cast(f"array<{SPAN}>"))).alias("spans")).select("row", "base", every.alias("spans"))


def find_pii(docs: DataFrame, reliability: float = 0.6, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, base and spans, arrays of (kind,
    start, end) with kind a place in KINDS or SECRET, positions in code points,
    end exclusive, ordered by start, then kind. spans holds base, the secrets and
    what the patterns discover.

    Null and empty texts have no spans. Repeated rows are searched each; a null
    doc_id stays null; an empty table gives an empty result. Columns besides
    the two named are not read.
    """
    rows = docs.select(F.struct(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("k")).alias("row"), F.col(text_col).cast("string").alias("text"))
    return bootstrap(rows, reliability, rounds).select("row.doc_id", "base", "spans")


def span_text(spans):
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, (*KINDS, "secret")))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of base spans), base_sha256,
    spans as text (of KINDS), n_discovered (those of them beside base), secrets
    as text, n_private (spans and secrets)."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    listed, secrets = F.filter("spans", lambda s: s["kind"] < SECRET), F.filter("spans", lambda s: s["kind"] == SECRET)
    return found.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), span_text(listed).alias("spans"), (F.size(listed) - F.size("base")).cast("long").alias("n_discovered"), span_text(secrets).alias("secrets"), F.size("spans").cast("long").alias("n_private"))


def _masked(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, found in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        if text and found:
            parts, at = [], 0
            for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= at:
                    parts += [text[at : s["start"]], f"[{(*KINDS, 'secret')[s['kind']].upper()}]"]
                at = max(at, s["end"])
            text = "".join(parts) + text[at:]
        out.append(text)
    return pa.array(out, pa.string())


def mask_pii(docs: DataFrame, reliability: float = 0.6, rounds: int = 3) -> DataFrame:
    """The rows of docs with every span of `text` replaced by its kind in
    brackets; overlapping spans give one replacement. Columns stay; a null or
    empty text stays as it is; repeated rows are masked each; an empty table
    stays empty. Only texts that may hold something are searched and moved."""
    ship(docs.sparkSession)
    rows = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    text = f"c{docs.columns.index('text')}"
    may = F.coalesce(F.regexp_like(text, F.lit(MAY)), F.lit(False))
    keyed = rows.where(may).withColumns({"k": F.xxhash64(text), "k2": F.xxhash64(F.lit(1), text)})
    searched = keyed.select(F.struct("k", "k2").alias("row"), F.col(text).alias("text"))
    spans = bootstrap(searched, reliability, rounds).where(F.size("spans") > 0).select("row.k", "row.k2", "spans").dropDuplicates(["k", "k2"])
    spans = written(spans, f"{workdir(docs.sparkSession, 'pii')}/spans")
    places = spans.agg(F.sum(F.size("spans"))).first()[0] or 0
    masked = keyed.join(small(spans, places), ["k", "k2"], "left").withColumn("masked", F.arrow_udf(_masked, "string")(F.col(text), F.col("spans")))
    masked = masked.select(*[F.col("masked").alias(c) if c == text else F.col(c) for c in rows.columns])
    return masked.unionByName(rows.where(~may)).toDF(*docs.columns)
