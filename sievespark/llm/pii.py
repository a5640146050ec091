"""Personal data: fixed base patterns, and looser spans chosen by boosted trees.

Base spans always stay. Beside them generous patterns propose spans of the same kinds that may overlap (spelled-out
addresses, numbers without a plus, other separators); boosted trees, grown on labelled examples, score each proposal
by its format and its neighbourhood, and thresholds set per kind on examples kept apart select the ones to add. The
trees are turned into column expressions, so texts are scored where they lie and nothing is shuffled.
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass
from itertools import groupby

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns, made possessive where nothing that follows could need a step back, so that long runs take
#: linear time and no recursion; a match starts where a run starts or where the match before it ended.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried.
_GUARD = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Generators: for each kind patterns whose matches may overlap one another's; the trees choose among them.
LOOSE = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?: ?[\[({](?:at|AT)[\])}] ?| (?:at|AT) )[A-Za-z0-9-]{1,63}+(?:(?: ?[\[({](?:dot|DOT)[\])}] ?| (?:dot|DOT) |\.)[A-Za-z0-9-]{1,63}+){1,6}",),
    "ip": (r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){2,7}+:?(?:[0-9A-Fa-f]{1,4}:){0,6}+[0-9A-Fa-f]{0,4}",),
    "card": (
        r"(?<![0-9])[0-9](?:[\x20._/-]{0,2}[0-9]){13,18}(?![0-9])",
        r"(?<![0-9])[0-9]{4}(?:[\x20._/-]{1,2}[0-9]{4}){3}(?![0-9])",
        r"(?<![0-9])[0-9]{4}[\x20._/-]{1,2}[0-9]{6}[\x20._/-]{1,2}[0-9]{4,5}(?![0-9])",
    ),
    "phone": (r"(?<![0-9+])(?:\([0-9]{2,5}\)|[0-9]{2,5})[\x20./-]{0,2}[0-9]{2,5}(?:[\x20./-]{0,2}[0-9]{2,5}){1,4}+(?![0-9])",),
}
_IP_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9]|)"
_NEAR = {
    "email": r"(?i)mail|contact|write|reach|schreib|kontakt|correo|courriel",
    "ip": r"(?i)\bip|host|server|addr|login|client|v6",
    "card": r"(?i)card|visa|credit|debit|payment|charged|karte|tarjeta|carte",
    "phone": r"(?i)phone|tel|call|mobil|cell|fax|dial|whatsapp|sms|llame|appel|ruf",
}
_COUNTED = r"(?i)(?:order|invoice|ref|serial|version|isbn|page|number|no\.?|id|hash|date|build|total|sku|part|#|№|\$|€)\W{0,3}$"
CONTEXT = 24


def with_value(value: Column, body) -> Column:
    """``body`` over ``value``, which is computed once a row however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running(numbers: Column, combine, ahead: bool = False) -> Column:
    """An array's leading parts combined, or with ``ahead`` its trailing ones, by doubling steps: n log n work."""
    steps = F.filter(F.array(*[F.lit(1 << i) for i in range(28)]), lambda s: s < F.size(numbers))
    near = lambda acc, i, s: F.get(acc, i + s if ahead else i - s)
    return F.aggregate(steps, numbers, lambda acc, s: F.transform(acc, lambda x, i: F.coalesce(combine(x, near(acc, i, s)), x)))


def running_sum(numbers: Column) -> Column:
    return running(numbers, lambda x, y: x + y)


SPAN = "array<struct<kind:int,start:int,end:int,value:string,left:string,right:string>>"


def spans(text: Column, pattern: str, kind: str, guard: Column) -> Column:
    """All leftmost matches with their places in code points and the text on either side.

    A match's end is the sum of all matches so far and of all text between them.
    """
    none = F.array().cast(SPAN)

    def placed(m: Column) -> Column:
        def of(p: Column) -> Column:
            ends = running_sum(F.transform(m, lambda x, i: F.length(x) + F.length(F.get(p, i))))
            one = lambda end, i: F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), (end - F.length(F.get(m, i))).alias("start"), end.alias("end"), F.get(m, i).alias("value"),
                F.right(F.get(p, i), F.lit(CONTEXT)).alias("left"), F.left(F.get(p, i + 1), F.lit(CONTEXT)).alias("right"),
            )
            return with_value(ends, lambda e: F.transform(e, one))

        return F.when(F.size(m) > 0, with_value(F.split(text, pattern), of).cast(SPAN)).otherwise(none)

    return F.when(guard, with_value(F.regexp_extract_all(text, F.lit(pattern), 0), placed)).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, c: Column) -> Column:
    if kind == "ip":
        return c["value"].rlike(rf"^{_IP_PART}(?:\.{_IP_PART}){{3}}$")
    d = digits(c["value"])
    if kind == "card":
        return F.length(d).between(14, 19) & F.call_function("luhn_check", d)
    return F.length(d).between(10, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """The base kind's matches that pass its test."""
    guard = text.contains(_GUARD[kind]) if _GUARD[kind] else F.lit(True)
    if kind != "email":
        guard = guard & text.rlike("[0-9]")
    return F.filter(spans(text, BASE[kind], kind, guard), lambda c: _valid(kind, c))


def proposals(text: Column) -> Column:
    """Spans of the generous patterns, of all kinds; they may overlap each other and base spans."""
    number = text.rlike("[0-9]{2}")
    guards = {"email": text.rlike(r"(?i)[\[({ ]at[\])} ]"), "ip": text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]"), "card": number, "phone": number}
    return F.concat(*[spans(text, pattern, k, guards[k]) for k in KINDS for pattern in LOOSE[k]])


def features(c: Column) -> Column:
    """Format and context of one proposal as numbers."""
    value, left, right = c["value"], c["left"], c["right"]
    d = digits(value)
    near = F.coalesce(*[F.when(c["kind"] == i, left.rlike(_NEAR[k])) for i, k in enumerate(KINDS)], F.lit(False))
    groups = F.array_remove(F.split(value, "[^0-9]+"), "")
    found = [
        c["kind"],
        F.length(value),
        F.length(d),
        F.length(F.regexp_replace(value, "[0-9A-Za-z]", "")),
        F.length(F.regexp_replace(value, "[^A-Za-z]", "")),
        F.call_function("luhn_check", d),
        value.startswith("0"),
        value.contains("("),
        F.size(groups),
        F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)),
        near,
        left.rlike(_COUNTED),
        left.rlike("[A-Za-z0-9_/.:=-]$"),
        right.rlike("^[A-Za-z0-9_/:=%-]|^[.][0-9]"),
        value.rlike(r"[\[({](?i:at|dot)[\])}]"),
        value.rlike("^[0-9]+[.][0-9]+([.][0-9]+)*$"),
        value.rlike("(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}"),
        value.rlike(r"^[0-9]{1,2}:[0-9]{2}:[0-9]{2}$"),
    ]
    return F.array(*[x.cast("double") for x in found])


@dataclass(frozen=True)
class Chooser:
    """Boosted trees as nested ``(feature, threshold, below, above)`` tuples or leaf values, and a threshold per kind."""

    trees: tuple
    weights: tuple[float, ...]
    thresholds: tuple[float, ...]

    def score(self, f: Column) -> Column:
        def grow(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            at, cut, below, above = node
            return F.when(F.get(f, F.lit(at)) <= cut, grow(below)).otherwise(grow(above))

        total = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights):
            total = total + F.lit(weight) * grow(tree)
        return 1 / (1 + F.exp(-2 * total))

    def selects(self, c: Column) -> Column:
        cut = F.get(F.array(*map(F.lit, self.thresholds)), c["kind"])
        return with_value(features(c), lambda f: self.score(f) >= cut)


def labelled_examples(per_kind: int = 250, seed: int = 7) -> list[dict]:
    """Labelled snippets ``{text, label}`` whose value stands between ``left`` and ``right``; a bounded, seeded set.

    Half are personal data in loose formats, half look alike: dates, versions, order numbers, times, sums, prose.
    A third of either half stands behind the same plain words, so that form must tell where context does not.
    """
    r = random.Random(seed)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("aeioulnrstdm") for _ in range(r.randint(3, 9)))

    def luhn() -> str:
        body = r.choice("3456") + num(14)
        total = sum(x if i % 2 else (x * 2 - 9 * (x > 4)) for i, x in enumerate(map(int, body)))
        return body + str(-total % 10)

    def good(kind: str) -> tuple[str, str]:
        if kind == "email":
            at, dot = r.choice([("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", "."), (" at ", " dot "), ("(at)", ".")])
            return r.choice(["mail me: ", "contact ", "email ", "write to ", f"{word()} "]), f"{word()}.{word()}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de'])}"
        if kind == "ip":
            return r.choice(["ip ", "host ", "server ", "client addr ", f"{word()} "]), ":".join(f"{r.randrange(65536):x}" for _ in range(8))
        if kind == "card":
            d, s = luhn(), r.choice([".", "/", "  ", "_", "- "])
            return r.choice(["card ", "visa ", "credit card: ", "payment by ", f"{word()} "]), s.join(d[i : i + 4] for i in (0, 4, 8, 12))
        s = r.choice(["-", " ", ".", "/"])
        return r.choice(["phone ", "tel. ", "call ", "mobile: ", "fax "]), r.choice([f"({num(3)}) {num(3)}{s}{num(4)}", f"0{num(3)}{s}{num(3)}{s}{num(4)}", f"{num(3)}{s}{num(3)}{s}{num(4)}", f"00{num(2)}{s}{num(3)}{s}{num(4)}{s}{num(2)}"])

    def bad(kind: str) -> tuple[str, str]:
        if kind == "email":
            return f"{word()} ", r.choice([f"{word()} at {word()}.{word()}", f"{word()} at {num(2)}.{num(2)}", f"{word()} at {word()} dot {word()} {word()}"])
        if kind == "ip":
            return r.choice(["at ", "time ", "chapter ", f"{word()} "]), r.choice([f"{num(2)}:{num(2)}:{num(2)}", f"{r.randrange(1, 13)}:{num(2)}:{num(2)}", f"{num(1)}:{num(2)}:{num(1)}", f"{num(3)}:{num(4)}:{num(2)}"])
        if kind == "card":
            return r.choice(["order ", "serial no. ", "ref ", "isbn ", f"{word()} ", "hash "]), r.choice([num(16), f"{num(4)}.{num(4)}.{num(4)}.{num(4)}", f"{num(8)}/{num(8)}", f"{num(2)}.{num(2)}.{num(4)} {num(8)}"])
        y = f"20{num(2)}"
        return r.choice(["date ", "version ", "order ", "ref ", "$", "pages ", f"{word()} ", "build ", f"{word()} "]), r.choice([f"{y}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.{y}", f"{num(2)}.{num(3)}.{num(3)}", num(9), num(12), f"{num(3)}.{num(2)}.{num(2)}.{num(3)}.{num(2)}", f"{y} {num(4)} {num(3)}", num(16), num(7)])

    out = []
    for kind in KINDS:
        for i in range(per_kind):
            for make, label in ((good, 1), (bad, 0)):
                left, value = make(kind)
                left = r.choice([f"{word()} ", "see ", "is ", "my ", f"{word()}: "]) if r.random() < 0.34 else left
                out.append({"left": f"{word()} {word()} {left}", "value": value, "right": r.choice(["", f" {word()} {word()}.", ", " + word(), ".", f" {num(2)}/{num(2)}", f" or {word()}"]), "label": label})
    return out


def fit(spark: SparkSession, examples: list[dict] | None = None, trees: int = 16, depth: int = 4, precision: float = 0.95, seed: int = 7) -> Chooser:
    """Trees grown on two thirds of the labelled examples; scores calibrated per kind on the last third.

    A proposal is right if it is the labelled value itself, not a part of it or more. Isotonic regression turns the
    scores of the examples kept apart into shares of right ones; a kind's threshold separates scores whose share is
    ``precision`` from those below; a kind that never reaches it is never added. The examples are a bounded set and don't grow
    with the corpus.
    """
    rows = json.dumps(examples if examples is not None else labelled_examples(seed=seed))
    table = spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<`left`:string,value:string,`right`:string,label:int>>")))
    table = table.select(F.concat("left", "value", "right").alias("text"), F.length("left").alias("from"), (F.length("left") + F.length("value")).alias("to"), "label")
    found = table.select("from", "to", "label", "text", F.explode(proposals(F.col("text"))).alias("c"))
    hit = (F.col("c.start") < F.col("to")) & (F.col("c.end") > F.col("from"))
    right = (F.col("label") == 1) & (F.col("c.start") == F.col("from")) & (F.col("c.end") == F.col("to"))
    found = found.where(hit).select(features(F.col("c")).alias("f"), right.cast("double").alias("label"), F.col("c.kind").alias("kind"), (F.pmod(F.xxhash64("text"), F.lit(3)) == 0).alias("apart"))
    grown = found.where("not apart").select(array_to_vector("f").alias("features"), "label")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed, maxBins=16, checkpointInterval=-1).fit(grown)
    shape = tuple(_nested(t._java_obj.rootNode()) for t in model.trees)
    chooser = Chooser(shape, tuple(model.treeWeights), (0.5,) * len(KINDS))
    apart = found.where("apart").select("kind", "label", chooser.score(F.col("f")).alias("score")).collect()
    return Chooser(shape, chooser.weights, tuple(_threshold([(r["score"], r["label"]) for r in apart if r["kind"] == i], precision) for i in range(len(KINDS))))


def _nested(node):
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return split.featureIndex(), float(split.threshold()), _nested(node.leftChild()), _nested(node.rightChild())


def calibrated(scored: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Steps ``(lowest score, share of right ones)`` of the isotonic regression of labels on scores."""
    steps: list[list[float]] = []
    for score, same in groupby(sorted(scored), key=lambda x: x[0]):
        labels = [y for _, y in same]
        steps.append([score, sum(labels), len(labels)])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            _, good, n = steps.pop()
            steps[-1][1] += good
            steps[-1][2] += n
    return [(score, good / n) for score, good, n in steps]


def _threshold(scored: list[tuple[float, float]], precision: float) -> float:
    """Halfway between the lowest score whose calibrated share is ``precision`` and the score before it."""
    lowest = next((score for score, share in calibrated(scored) if share >= precision), 2.0)
    return lowest if lowest > 1 else (lowest + max((s for s, _ in scored if s < lowest), default=0.0)) / 2


_PLACE = "struct<kind:int,start:int,end:int>"


def _clear(loose: Column, base: Column) -> Column:
    """The spans of ``loose`` that overlap none of ``base``: those before have ended and the next one starts behind."""
    entry = lambda over: lambda c: F.struct(c["start"].alias("start"), F.lit(over).alias("loose"), c["end"].alias("end"), c["kind"].alias("kind"))

    def of(every: Column) -> Column:
        ended = running(F.transform(every, lambda c: F.when(c["loose"] == 0, c["end"]).otherwise(F.lit(0))), F.greatest)
        coming = running(F.transform(every, lambda c: F.when(c["loose"] == 0, c["start"]).otherwise(F.lit((1 << 31) - 1))), F.least, ahead=True)
        keep = lambda e: lambda c, i: (c["loose"] == 1) & (F.get(e["ended"], i) <= c["start"]) & (F.get(e["coming"], i) >= c["end"])
        return with_value(F.struct(ended.alias("ended"), coming.alias("coming")), lambda e: F.filter(every, keep(e)))

    both = F.array_sort(F.concat(F.transform(base, entry(0)), F.transform(loose, entry(1))))
    found = F.transform(with_value(both, of), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return F.when((F.size(base) > 0) & (F.size(loose) > 0), found.cast(f"array<{_PLACE}>")).otherwise(loose)


def _first_come(loose: Column) -> Column:
    """Of spans that overlap each other the one that starts first stays, the longer and then the earlier kind of ties.

    A fold over the sorted spans that keeps the end of the last one kept, in runs of about root n spans, as an
    array is copied whenever something is put to it.
    """

    def keep(acc: Column, c: Column) -> Column:
        one = F.array(F.struct(c["kind"].alias("kind"), c["start"].alias("start"), (-c["back"]).alias("end")).cast(_PLACE))
        clear = c["start"] >= acc["at"]
        return F.struct(F.when(clear, -c["back"]).otherwise(acc["at"]).alias("at"), F.when(clear, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def one_run(acc: Column, run: Column) -> Column:
        found = F.aggregate(run, F.struct(acc["at"].alias("at"), F.array().cast(f"array<{_PLACE}>").alias("out")), keep)
        return with_value(found, lambda v: F.struct(v["at"].alias("at"), F.concat(acc["out"], F.array(v["out"])).alias("out")))

    def of(ordered: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(ordered))).cast("int")
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(ordered) - 1) / size).cast("int")), lambda i: F.slice(ordered, i * size + 1, size))
        return F.flatten(F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_PLACE}>>").alias("out")), one_run, lambda acc: acc["out"]))

    ordered = F.array_sort(F.transform(loose, lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("back"), c["kind"].alias("kind"))))
    return F.when(F.size(loose) > 1, with_value(ordered, of)).otherwise(loose)


def find(docs: DataFrame, chooser: Chooser, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, email, ip, card, phone, added)`` per row; arrays of ``(kind, start, end)`` in code points.

    ``added`` holds the chosen proposals that overlap no base span; of chosen ones that overlap each other the
    one that starts first stays, the longer and then the earlier kind of ties. A null text counts as empty and
    has none; repeated rows each keep a row; an empty table gives none.
    """
    slim = lambda a: F.transform(a, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.select("id", "text", *[slim(base_spans(F.col("text"), k)).alias(k) for k in KINDS], proposals(F.col("text")).alias("_loose"))
    rows = rows.withColumn("_base", F.concat(*KINDS)).withColumn("_loose", slim(F.filter("_loose", chooser.selects)))
    rows = rows.withColumn("_loose", _clear(F.col("_loose"), F.col("_base")))
    return rows.select("id", "text", *KINDS, _first_come(F.col("_loose")).alias("added"))


def listed(found: Column) -> Column:
    """``kind:start:end`` of each span by start, then kind, joined by commas."""
    ordered = F.array_sort(F.transform(found, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(ordered, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["start"], c["end"])), ",")


def redact(found: DataFrame) -> DataFrame:
    """``(id, text)`` with every span of ``find`` replaced by its kind in brackets; overlapping spans become one."""
    every = F.array_sort(F.transform(F.concat(*KINDS, "added"), lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("back"), c["kind"].alias("kind"))))
    names = F.array(*map(F.lit, KINDS))

    def put(e: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            before = F.coalesce(F.get(e["ended"], i - 1), F.lit(0))
            gap = F.array_join(F.slice(e["chars"], before + 1, F.greatest(c["start"] - before, F.lit(0))), "")
            return F.when(c["start"] >= before, F.concat(gap, F.lit("["), F.get(names, c["kind"]), F.lit("]"))).otherwise(F.lit(""))

        rest = F.array_join(F.slice(e["chars"], F.element_at(e["ended"], -1) + 1, F.size(e["chars"])), "")
        return F.concat(F.array_join(F.transform(e["spans"], one), ""), rest)

    def of(spans: Column) -> Column:
        ended = running(F.transform(spans, lambda c: -c["back"]), F.greatest)
        return with_value(F.struct(spans.alias("spans"), ended.alias("ended"), F.regexp_extract_all("text", F.lit("(?s)."), 0).alias("chars")), put)

    return found.select("id", F.when(F.size(every) > 0, with_value(every, of)).otherwise(F.col("text")).alias("text"))
