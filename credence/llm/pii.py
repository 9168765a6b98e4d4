"""Personal data: rules, high-recall candidate spans, and boosted trees that select among them, in SQL expressions only.

Rules (``email``, ``ip``, ``card``, ``phone``) are kept as they are. Generators propose further spans, which may overlap: e-mail
addresses that are spelled out, in brackets or bare (``mail``), telephone numbers without a plus sign (``tel``), identity numbers
of three groups (``ssn``), bank accounts (``iban``) and colon-separated addresses, shortened or not (``ip6``). Each candidate gets
a vector: its format in small integers (digits, groups, separators, lengths, a check that holds, what it touches), and hashed
character 3-grams of the ``AROUND`` characters on each side and of its own words, and the last three words before, hashed. No word list is among the features.

Boosted trees (depth 3, logistic loss), an ensemble a kind, score the vectors; context enters as stumps on
3-grams. They are fitted on ``EXAMPLES`` sentences of each kind, personal or not
by the frame and shape they were made from: numbers of one shape as telephone, order, part or page numbers, valid and invalid
accounts, addresses, clock times, hardware addresses and scopes of programs, spelled-out addresses and words that look like them.
Frames are few, so a third of the frames (not of the sentences) is held out; on it each kind's limit is set where ``PRECISION``
is kept. Spans that reach the limit are selected, unless they begin within a rule's span. The model does not depend on the
tables it is used on.

Everything per row is a DataFrame expression: patterns are matched inside the JVM, and only in texts that hold a character the
pattern cannot do without; positions are sums in blocks of ``BLOCK`` matches, trees become CASE expressions. The work grows in
proportion to the text and its matches.

Edge cases: null and empty texts have no spans; positions count code points; spans are sorted by start, then by kind in the
order of ``KINDS``; patterns are written to take time in proportion to the text and bounded stack, whatever it holds; equal
rows get equal results; empty tables give no rows; other columns pass untouched.
"""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

KINDS = ["email", "ip", "card", "phone", "mail", "tel", "ssn", "iban", "ip6"]
RULES = KINDS[:4]
EXTRA = KINDS[4:]
EXAMPLES = {"mail": 1800, "tel": 6000, "ssn": 2400, "iban": 900, "ip6": 900}
PRECISION = 0.95  # on frames that are held out, where a fiftieth of the look-alikes cannot be told apart
LEAST = 0.0  # no limit below an even chance
BLOCK = 512

#: The shapes of the rules. The guards in front only rule out starts from which the pattern could not match
#: or at which a longer match has begun, so that no run of characters is scanned twice.
PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "mail": r"(?i)(?<![a-z0-9._-])[a-z0-9][a-z0-9._-]{1,40}+(?: ?[\[({]at[\])}] ?| at )[a-z0-9][a-z0-9-]{1,40}+(?:(?: ?[\[({]dot[\])}] ?| dot )[a-z0-9][a-z0-9-]{1,24}+){1,3}",
    "tel": r"(?<![0-9+.-])(?:(?:\([0-9]{2,5}\) ?|0[0-9]{1,4}[ /-])[0-9]{2,8}(?:[ -][0-9]{2,6}){1,3}|0[0-9]{1,4}[ /-][0-9]{5,8})(?![0-9])|(?<![0-9+.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])",
    "ip6": r"(?i)(?<![0-9a-z:])(?:(?:[0-9a-f]{1,4}:){4,7}[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}:){1,6}(?::[0-9a-f]{1,4}){1,6})(?![0-9a-z:])",
}
#: What a text must hold for a pattern to match at all.
NEEDS = {"email": "@", "phone": "+", "ssn": "-", "ip6": ":"}
AROUND = 24  # characters of context on each side
#: Places of hashed 3-grams (before, after, the candidate's own words) and of the last three words before.
SIDES = (512, 256, 256, 1024)

FEATURES = ["kind", "digits", "letters", "groups", "marks", "variety", "tail", "first", "check", "edge", "lead", "follow", "dotted", "bare", "longest"]


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether the digits of x pass the Luhn check."""
    d = F.reverse(digits_of(x))
    one = lambda i: F.substring(d, i, F.lit(1)).cast("int")
    doubled = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    parts = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.when(i % 2 == 1, one(i)).otherwise(doubled(one(i))))
    return F.when(F.length(d) > 0, F.aggregate(parts, F.lit(0), lambda a, b: a + b) % 10 == 0).otherwise(F.lit(False))


def iban_valid(x: Column) -> Column:
    """Whether the account number, turned around and read as a number, leaves 1 when divided by 97."""
    raw = F.regexp_replace(x, " ", "")
    turned = F.concat(F.substring(raw, F.lit(5), F.length(raw)), F.substring(raw, 1, 4))
    step = lambda a, c: F.when(F.length(c) == 0, a).when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


_FIRST_PART = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_IP_FINE = _FIRST_PART + "".join(r"\." + _FIRST_PART[1:] for _ in range(3)) + "$"


def passes(kind: str, x: Column) -> Column:
    """The check that a rule's match has to pass."""
    n = F.length(digits_of(x))
    return {"email": F.lit(True), "ip": x.rlike(_IP_FINE), "card": n.between(12, 19) & luhn(x), "phone": n.between(9, 15)}[kind]


_MATCH = "array<struct<a:int,b:int,m:string,left:string,right:string>>"


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def before(values: Column, combine) -> Column:
    """What ``combine`` makes of all values in front of each one (integers, 0 to begin with). Blocks are combined one by one,
    so that the arrays that grow stay short."""
    zero, none = F.lit(0), F.array().cast("array<int>")
    inner = lambda block: F.aggregate(block, F.struct(zero.alias("at"), none.alias("out")), lambda s, v: F.struct(combine(s["at"], v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
    cut = lambda v: F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / BLOCK).cast("int")), lambda i: F.slice(v, i * BLOCK + 1, BLOCK))

    def run(v: Column) -> Column:
        return bound(cut(v), lambda blocks: F.flatten(F.zip_with(blocks, inner(F.transform(blocks, lambda x: F.aggregate(x, zero, combine))), lambda x, at: F.transform(inner(x), lambda y: combine(at, y)))))

    return bound(values, lambda v: F.when(F.size(v) > 0, run(v)).otherwise(none))


def matches(kind: str, text: Column) -> Column:
    """The pattern's matches: start, end (code points), text, and what stands before and after.

    Splitting at the matches and extracting them walk the text alike, so positions are running sums of both."""
    none = F.array().cast(_MATCH)

    def placed(found: Column, gaps: Column) -> Column:
        sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
        rows = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("g"), found.alias("m"), before(sizes, lambda x, y: x + y).alias("at"), F.slice(gaps, F.lit(2), F.size(found)).alias("n"))

        def one(z):
            a = z["at"] + F.length(z["g"])
            return F.struct(a.alias("a"), (a + F.length(z["m"])).alias("b"), z["m"].alias("m"), F.right(z["g"], F.lit(AROUND)).alias("left"), F.left(z["n"], F.lit(AROUND)).alias("right"))

        return F.transform(rows, one)

    found = F.regexp_extract_all(text, F.lit(PATTERN[kind]), F.lit(0))
    if kind in NEEDS:
        found = F.when(text.contains(NEEDS[kind]), found).otherwise(F.array().cast("array<string>"))
    return bound(found, lambda f: F.when(F.size(f) > 0, bound(F.split(text, PATTERN[kind], -1), lambda g: placed(f, g))).otherwise(none))


def _grams(x: Column, side: int) -> Column:
    """Places of the 3-grams of x, digits alike."""
    first, places = len(FEATURES) + sum(SIDES[:side]), SIDES[side]
    plain = F.regexp_replace(x, "[0-9]", "0")
    return F.when(F.length(x) > 2, F.transform(F.sequence(F.lit(1), F.length(x) - 2), lambda i: F.pmod(F.hash(F.substring(plain, i, F.lit(3))), F.lit(places)) + first)).otherwise(F.array().cast("array<int>"))


def _words(x: Column) -> Column:
    """Places of the last three words of x."""
    first = len(FEATURES) + sum(SIDES[:3])
    return F.transform(F.slice(F.reverse(F.regexp_extract_all(x, F.lit(r"\p{L}+|#"), F.lit(0))), 1, 3), lambda w: F.pmod(F.hash(w), F.lit(SIDES[3])) + first)


def _touched(x: Column) -> Column:
    """What kind of character a context has next to the candidate, spaces aside."""
    return F.when(F.length(x) == 0, 0).when(x.rlike("[A-Za-z]"), 1).when(x == ":", 2).when(x == "#", 3).when(x.rlike("[0-9]"), 4).when(x.rlike("[=/$%*_-]"), 5).when(x.rlike(r"[.,;!?()\[\]]"), 6).otherwise(7)


def _described(kind: str, x: Column) -> Column:
    """A match of a generator as span and vector."""
    m, left, right = x["m"], F.lower(x["left"]), F.lower(x["right"])
    digits = digits_of(m)
    count = lambda y, most: F.least(F.length(y), F.lit(most))
    parts = F.regexp_extract_all(m, F.lit("[0-9A-Za-z]+"), F.lit(0))
    values = {
        "kind": F.lit(KINDS.index(kind)),
        "digits": count(digits, 40),
        "letters": count(F.regexp_replace(m, "[^A-Za-z]", ""), 40),
        "groups": F.least(F.size(parts), F.lit(12)),
        "marks": F.least(F.size(F.array_distinct(F.regexp_extract_all(m, F.lit("[^0-9A-Za-z]"), F.lit(0)))), F.lit(4)),
        "variety": F.size(F.array_distinct(F.split(digits, ""))),
        "tail": count(F.regexp_extract(m, "[0-9A-Za-z]+$", 0), 12),
        "first": F.when(m.startswith("("), 2).when(m.startswith("0"), 1).when(m.startswith("1"), 3).otherwise(0),
        "check": (iban_valid(m) if kind == "iban" else F.lit(False)).cast("int"),
        "edge": F.when(right.rlike("^[a-z0-9]"), 2).when(left.rlike("[a-z0-9]$"), 1).otherwise(0),
        "lead": _touched(F.right(F.rtrim(left), F.lit(1))),
        "follow": _touched(F.left(F.ltrim(right), F.lit(1))),
        "dotted": m.rlike("^[A-Za-z0-9]*[._0-9-]").cast("int"),
        "bare": F.lower(m).contains(" at ").cast("int"),
        "longest": F.least(F.array_max(F.transform(parts, F.length)), F.lit(20)),
    }
    own = F.concat(F.lit(" "), F.lower(F.regexp_replace(F.regexp_extract(m, "[^A-Za-z]([A-Za-z]+[^A-Za-z]+[A-Za-z]+[^A-Za-z]+[A-Za-z]+)$", 1), "[^A-Za-z]+", " ")), F.lit(" "))
    grams = F.array_distinct(F.concat(_grams(left, 0), _grams(right, 1), _words(left), _grams(own, 2) if kind == "mail" else F.array().cast("array<int>")))
    return F.struct(x["a"].alias("a"), x["b"].alias("b"), *[values[f].cast("int").alias(f) for f in FEATURES], grams.alias("grams"))


def _describer(kind: str):
    return lambda x: _described(kind, x)


def _verdict(kind: str):
    return lambda x: passes(kind, x["m"])


_SPANS = "array<struct<a:int,b:int,kind:int>>"


def _bare(kind: Column | None = None):
    return lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), (x["kind"] if kind is None else kind).alias("kind"))


def _order(x: Column, y: Column) -> Column:
    return F.when(x["a"] != y["a"], x["a"] - y["a"]).otherwise(x["kind"] - y["kind"])


def rule_spans(text: Column) -> Column:
    """Spans of the rules whose checks hold, sorted."""
    parts = [F.transform(F.filter(matches(k, text), _verdict(k)), _bare(F.lit(i))) for i, k in enumerate(RULES)]
    return F.array_sort(F.concat(*parts), _order)


def candidates(text: Column) -> Column:
    """Spans and vectors of all generators."""
    return F.concat(*[F.transform(matches(k, text), _describer(k)) for k in EXTRA])


# --- boosting over a table of distinct vectors ---------------------------------------------------------------------------


def boost(table: list[tuple[tuple, float, float]], rounds: int = 40, rate: float = 0.3, depth: int = 3, context: int | None = None, stumps: int = 15) -> list:
    """table: (vector, negatives, positives). Trees: (feature, cut, left, right), leaves: numbers. Each round grows a tree on the
    columns before ``context`` and then some stumps on the others, which are 0 or 1."""
    x = np.array([r for r, _, _ in table], dtype=np.int64)
    negatives, positives = (np.array([t[k] for t in table], dtype=float) for k in (1, 2))
    context = x.shape[1] if context is None else context
    flags = x[:, context:].astype(np.float32)
    score = np.zeros(len(x))
    trees = []

    def slopes():
        p = 1 / (1 + np.exp(-score))
        return (negatives + positives) * p - positives, (negatives + positives) * p * (1 - p)

    def gains(g, h, right_g, right_h):
        left_g, left_h = g - right_g, h - right_h
        return np.where((right_h > 1e-6) & (left_h > 1e-6), right_g**2 / (right_h + 1) + left_g**2 / (left_h + 1) - g**2 / (h + 1), 0)

    def leaf(g, h, rows):
        value = float(-rate * g[rows].sum() / (h[rows].sum() + 1))
        score[rows] += value
        return value

    def grow(g, h, rows, depth):
        best = (1e-6, 0, 0)
        for f in range(context) if depth else ():
            v = x[rows, f]
            gs, hs = np.bincount(v, g[rows]), np.bincount(v, h[rows])
            gain = gains(gs.sum(), hs.sum(), gs.sum() - gs.cumsum()[:-1], hs.sum() - hs.cumsum()[:-1])
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), f, int(gain.argmax()))
        if best[0] == 1e-6:
            return leaf(g, h, rows)
        low = x[rows, best[1]] <= best[2]
        return best[1], best[2], grow(g, h, rows[low], depth - 1), grow(g, h, rows[~low], depth - 1)

    for _ in range(rounds):
        trees.append(grow(*slopes(), np.arange(len(x)), depth))
        for _ in range(stumps if flags.shape[1] else 0):
            g, h = slopes()
            right = np.stack([g, h]).astype(np.float32) @ flags
            gain = gains(g.sum(), h.sum(), right[0].astype(float), right[1].astype(float))
            f = int(gain.argmax())
            has = flags[:, f] > 0
            trees.append((context + f, 0, leaf(g, h, np.flatnonzero(~has)), leaf(g, h, np.flatnonzero(has))))
    return trees


def tree_column(tree, x: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, cut, left, right = tree
    return F.when(x[FEATURES[f]] <= cut, tree_column(left, x)).otherwise(tree_column(right, x))


def tree_value(tree, row: tuple) -> float:
    while isinstance(tree, tuple):
        f, cut, left, right = tree
        tree = left if row[f] <= cut else right
    return tree


def _looked_up(weights: Column):
    return lambda total, gram: total + F.element_at(weights, gram + 1)


class Model:
    """Trees and the limit of each kind."""

    def __init__(self, trees: dict[int, list], limits: dict[int, float]):
        self.trees, self.limits = trees, limits

    def score(self, x: Column) -> Column:
        """Stumps on 3-grams add up to one weight a gram, so a candidate's context is looked up once, however many they are."""
        out = F.lit(-math.inf)
        for kind, trees in self.trees.items():
            stumps = [t for t in trees if isinstance(t, tuple) and t[0] >= len(FEATURES)]
            weights = [0.0] * (len(FEATURES) + sum(SIDES))
            for f, _, without, has in stumps:
                weights[f] += has - without
            whole = sum((tree_column(t, x) for t in trees if t not in stumps), F.lit(sum(t[2] for t in stumps)))
            looked_up = F.expr(f"array({','.join(f'{w:.9g}D' for w in weights)})")
            whole = F.aggregate(x["grams"], whole, _looked_up(looked_up))
            out = F.when(x["kind"] == kind, whole).otherwise(out)
        return out

    def selects(self, x: Column) -> Column:
        limit = F.lit(math.inf)
        for k, v in self.limits.items():
            limit = F.when(x["kind"] == k, F.lit(v)).otherwise(limit)
        return self.score(x) >= limit


#: Fillers of sentences of either kind.
WORDS = "the house water stone river green under paper again letter garden seven market window this that one all here now then noon wall over out very much more some end top day street last left right red point and or of in on it is so we he she they you if nobody anybody answers asks use used try just after before live lives come comes by from with has had was were will would can please see said signed doctor practice school state family student group country city world people time year week month way man woman child friend about into between against because while where when who what which there their our your my her his its not no yes old new good great small large long early late open close read write walk talk think know want need find give take make keep put goes went gone berlin london paris madrid ann lee weber und der die das ist von mit auf el la los con para les des est pour".strip()
#: Frames of sentences, by kind: around personal data, and around what looks like it. Fillers and frames without a word of
#: their own (``OPEN``) are alike on both sides.
OPEN = ["{}", "{} ", ", {}, ", ". {}. ", " ({}) ", "\n{}\n", "; {}; ", " - {} - ", " {}! ", " {}? ", " and {} or ", " und {} oder "]
CALLS = "call|phone|telephone|tel|fax|mobile|cell|ring|reach|text|dial|contact|hotline|voicemail|whatsapp|sms|number|Telefon|Rufnummer|Handy|Mobilnummer|llame|appelez|numero|office line|home line|emergency contact|my number|his number|her number".split("|")
CALL_FORMS = ["W {}", "W: {}", "W me on {}", "W is {}", "W. {}", "my W is {}", "W us at {}", "W {} now", "or W {} for help", "{} is the W", "W number {}", "(W {})"]
COUNTS = "order|serial|part|item|invoice|page|version|build|ISBN|SKU|score|row|table|section|chapter|figure|model|ticket|case|lot|batch|tracking|shipment|parcel|product|article|catalog|reference|ref|code|receipt|Bestellung|Rechnung|Artikel|pedido|factura|commande|line|patent|flight|total|barcode|license|revision|sequence|unit|record|file|stock".split("|")
COUNT_FORMS = ["W {}", "W: {}", "W no. {}", "W number {}", "W is {}", "the W {} was", "W #{}", "W Nr. {}", "your W {} has", "W numbers {} and", "W with number {}", "{} is the W", "W id {}", "as W {}", "= {}", "#{}", "no. {}", "W={}"]
SOCIAL = "SSN|social security|social security number|social|insurance number|national insurance|taxpayer|tax id|identity number|employee SSN|patient SSN|applicant SSN".split("|")
SOCIAL_FORMS = ["W {}", "W: {}", "W is {}", "her W is {}", "W no. {}", "W={}", "{} as W", "W of {}", "(W {})", "my W is {}"]


def _forms(forms: list[str], words: list[str]) -> list[str]:
    return [f.replace("W", w) for f in forms for w in words]


FRAMES = {
    "mail": (["mail {}", "e-mail: {}", "write to {}", "contact {}", "reach me: {}", "my address is {}", "email {} for more", "send it to {}", "questions? {}", "schreib an {}", "correo: {}", "ask {}"], ["look {}", "they met {}", "we stood {}", "he stopped {}", "she saw the {}", "it is {}", "the train stood {}", "look up the {}"]),
    "tel": (_forms(CALL_FORMS, CALLS), _forms(COUNT_FORMS, COUNTS)),
    "ssn": (_forms(SOCIAL_FORMS, SOCIAL), _forms(COUNT_FORMS, COUNTS)),
    "iban": (["IBAN {}", "account {}", "bank account: {}", "Konto {}", "transfer to {}", "cuenta {}", "compte {}", "pay into {}", "Kontonummer {}"], ["IBAN {}", "account {}", *_forms(COUNT_FORMS[:4], COUNTS)]),
    "ip6": (["ip {}", "ipv6 address {}", "host {}", "server {}", "login from {}", "ping {}", "connected to {}", "route via {}", "listen on {}", "dns {}"], ["at {}", "time {}", "ratio {}", "from {}", "score {}", "clock {}", "call {}", "using {}", "mac {}", "started {}"]),
}


def examples(each: dict[str, int] = EXAMPLES, seed: int = 4) -> list[tuple[int, str, int, int]]:
    """(kind, sentence, whether its number is personal, number of its frame), ``each`` gives how many of a kind."""
    r = random.Random(seed)
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    made_up = lambda: "".join(r.choice("bcdfghklmnprstvwz") + r.choice("aeiou") for _ in range(r.randint(1, 4))) + r.choice(["", "n", "s", "t", "r"])
    plain = WORDS.split()
    word = lambda: r.choice(plain) if r.random() < 0.6 else made_up()

    def tel(yes):
        shape = r.randrange(8) if r.random() < (0.6 if yes else 0.3) else 7  # look-alikes have the shape without brackets or zeros mostly
        if shape < 2:
            return f"({r.choice(['0', ''])}{number(3)}) {number(3)}{r.choice(' -')}{number(4)}"
        if shape == 2:
            return f"0{number(r.randint(2, 3))}{r.choice(' -/')}{number(r.randint(5, 8))}"
        if shape == 3:
            return f"0{number(r.randint(2, 3))}{r.choice(' -/')}{number(3)} {number(r.randint(3, 5))}"
        mark = r.choice("- .")
        return f"{r.randint(200, 989)}{mark}{number(3)}{mark}{number(4)}"

    def iban(yes):
        land, rest = r.choice(["DE", "FR", "ES", "GB", "NL", "IT", "PL"]), number(r.choice([12, 14, 16, 18, 20]))
        check = 98 - int(rest + "".join(str(ord(c) - 55) for c in land) + "00") % 97
        if not yes:
            check = (check + r.randint(1, 90)) % 98
        whole = f"{land}{check:02d}{rest}"
        return " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)) if r.random() < 0.6 else whole

    def ip6(yes):
        group = lambda: f"{r.getrandbits(r.choice([4, 8, 12, 16, 16, 16])):x}"
        two = lambda: f"{r.randint(0, 59):02d}"
        if yes and r.random() < 0.5:
            return ":".join(group() for _ in range(8))
        if yes:
            first = r.choice(["2001", "fe80", "fd00", "2a02", "2607", f"{r.randint(0x2000, 0x3FFF):x}"])
            return ":".join([first, *[group() for _ in range(r.randint(0, 3))]]) + "::" + ":".join(group() for _ in range(r.randint(1, 4)))
        shape = r.randrange(5)
        if shape < 2:
            return ":".join(two() for _ in range(r.randint(5, 8)))
        if shape == 2:
            return ":".join(f"{r.getrandbits(8):02x}" for _ in range(6))
        if shape == 3:
            return "::".join(r.choice(["a", "be", "cab", "dad", "fade", "bed", "ace", "add", "dead", "beef", "face", "cafe", "bad", "fee"]) for _ in range(2))
        return f"{r.randint(1, 99)}::{r.randint(1, 99)}"

    def mail(yes):
        bare = r.random() < 0.35
        at, dot = (" at ", " dot ") if bare else r.choice([("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) "), (" {at} ", " {dot} ")])
        known = "com org net de fr es io edu eu co info uk online app dev shop cloud ch at nl pl museum travel".split()
        dotted = lambda: r.choice([f"{word()}{r.choice('._-')}{word()}", f"{made_up()}{number(2)}", f"{r.choice('abcdefgh')}.{made_up()}"])
        if yes:
            local, end = (dotted(), r.choice(known) if r.random() < 0.7 else made_up()) if r.random() < 0.7 else (made_up(), r.choice(known))
            host = r.choice(["mail", "example", "web", made_up(), made_up(), f"{made_up()}-{made_up()}", word()])
            return f"{local}{at}{host}{dot}{end}" + (f"{dot}uk" if end == "co" else "")
        return f"{word()}{at}{word()}{dot}{word()}"

    made = {"mail": mail, "tel": tel, "ssn": lambda yes: f"{number(3)}-{number(2)}-{number(4)}", "iban": iban, "ip6": ip6}
    out = []
    for kind, make in made.items():
        for _ in range(each[kind]):
            yes = r.random() < 0.5
            # numbers of one shape are personal where nothing speaks against it
            open_ = r.random() < (0.55 if yes else 0.02 if kind in ("tel", "ssn") else 0.5)
            frames = OPEN if open_ else FRAMES[kind][0 if yes else 1]
            at = r.randrange(len(frames))
            fillers = lambda n: " ".join(word() for _ in range(r.randint(0, n)))
            frame = frames[at].capitalize() if r.random() < 0.15 else frames[at]
            text = fillers(6) + r.choice([" ", " ", ". ", ", "]) + frame.replace("{}", make(yes)) + r.choice([" ", ".", ", ", "; "]) + fillers(5)
            out.append((KINDS.index(kind), text.replace("'", ""), int(yes), zlib.crc32(frames[at].encode())))
    return out


def fit(spark: SparkSession, precision: float = PRECISION) -> Model:
    """Boost on two thirds of the frames, then set each kind's limit on the others where the wanted precision is kept."""
    values = ",".join(f"({i},{kind},'{text}',{yes},{frame}L)" for i, (kind, text, yes, frame) in enumerate(examples()))
    frame = spark.sql(f"SELECT * FROM VALUES {values} AS t(i, wanted, text, yes, frame)")  # noqa: S608
    x = F.col("x")
    rows = frame.select("i", "wanted", "yes", "frame", F.explode(candidates(F.col("text"))).alias("x")).where(x["kind"] == F.col("wanted")).select("i", (F.col("frame") % 3 == 0).alias("held"), "yes", *[x[f].alias(f) for f in FEATURES], x["grams"].alias("grams")).collect()  # EXAMPLES of each kind
    counts: dict[tuple[int, bool], list] = {}
    for row in sorted(rows, key=lambda r: r["i"]):
        vector = np.zeros(len(FEATURES) + sum(SIDES), np.int64)
        vector[: len(FEATURES)] = [row[f] for f in FEATURES]
        vector[row["grams"]] = 1
        counts.setdefault((row["kind"], row["held"]), []).append((vector, float(1 - row["yes"]), float(row["yes"])))
    trees, limits = {}, {}
    for kind in range(len(RULES), len(KINDS)):
        trees[kind] = boost(counts[kind, False], context=len(FEATURES))
        own = sorted(((sum(tree_value(t, v) for t in trees[kind]), n, y) for v, n, y in counts[kind, True]), reverse=True)
        limit, good, all_ = math.inf, 0.0, 0.0
        for k, (s, n, y) in enumerate(own):
            good, all_ = good + y, all_ + n + y
            if good >= precision * all_ and s > LEAST and (k + 1 == len(own) or own[k + 1][0] < s):
                limit = (s + own[k + 1][0]) / 2 if k + 1 < len(own) else s - 1.0  # half-way to the next score: no tie with a sum in another order
        limits[kind] = limit
    return Model(trees, limits)


_fitted: dict[float, Model] = {}


def fitted(spark: SparkSession, precision: float = PRECISION) -> Model:
    """The model, fitted once in a process: it does not depend on any table."""
    if precision not in _fitted:
        _fitted[precision] = fit(spark, precision)
    return _fitted[precision]


def all_spans(rules: Column, found: Column, model: Model) -> Column:
    """Rule spans and selected candidates, sorted. Candidates that begin within a rule's span are left out."""
    chosen = F.transform(F.filter(found, model.selects), _bare())

    def merged(some: Column) -> Column:
        both = F.array_sort(F.concat(rules, some), _order)

        def free(spans: Column) -> Column:
            reach = before(F.transform(spans, lambda x: F.when(x["kind"] < len(RULES), x["b"]).otherwise(0)), lambda x, y: F.greatest(x, y))
            kept = F.filter(F.arrays_zip(spans.alias("x"), reach.alias("reach")), lambda z: (z["x"]["kind"] < len(RULES)) | (z["reach"] <= z["x"]["a"]))
            return F.transform(kept, lambda z: z["x"])

        return F.when(F.size(some) > 0, bound(both, free)).otherwise(rules)

    return F.when(F.size(found) > 0, bound(chosen, merged)).otherwise(rules)


def find_personal_data(docs: DataFrame, keep: list[str], model: Model | None = None) -> DataFrame:
    """``keep`` columns with ``base`` and ``spans``: arrays of (a, b, kind code)."""
    model = model or fitted(docs.sparkSession)
    plain = docs.select(*[F.col(c).alias(f"_x{i}") for i, c in enumerate(keep)], F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    found = plain.select(*[f"_x{i}" for i in range(len(keep))], rule_spans(F.col("_text")).alias("base"), candidates(F.col("_text")).alias("_found"))
    both = found.select(*[f"_x{i}" for i in range(len(keep))], "base", all_spans(F.col("base"), F.col("_found"), model).alias("spans"))
    return both.toDF(*keep, "base", "spans")


def redact(text: Column, spans: Column, kinds: list[str] = KINDS) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in kinds])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s, x):
        piece = F.concat(s["out"], F.substring(text, s["at"] + 1, x["a"] - s["at"]), F.element_at(names, x["kind"] + 1))
        return F.when(x["a"] >= s["at"], F.struct(x["b"].alias("at"), piece.alias("out"))).otherwise(s)

    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["a"].cast("string"), x["b"].cast("string"))), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text."""
    found = find_personal_data(documents(spark, sf_dir), ["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{RULES[k]}")
    return found.select("doc_id", *[count(k) for k in range(4)], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
