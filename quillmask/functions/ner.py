"""From a token classifier's output to spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmask.functions.patterns import SPANS, span
from quillmask.functions.spans import moved
from quillmask.functions.text import WIDE_SPACE

# Model labels and the types they stand for; words that are fields, not names.
LABELS = {
    "PERSON": "NAME", "LOCATION": "ADDRESS", "EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE", "CREDIT_CARD": "CARD",
    "PASSWORD": "PASSWORD", "FINANCIAL": "ACCOUNT", "US_BANK_NUMBER": "ACCOUNT", "IBAN_CODE": "ACCOUNT", "IP_ADDRESS": "IP",
}
FIELD_WORDS = "upi id vpa pan otp pin ifsc cvv kyc dob aadhaar aadhar uid email mobile phone gstin account card code no number".split()
DEFAULT_TYPES = ("NAME", "ADDRESS")
#: A flat or house number that ends where an address begins.
HOUSE = f"(?i)(?:^|[{WIDE_SPACE}:])((?:(?:flat|house|no\\.?|#)[{WIDE_SPACE}]*)?\\d{{1,5}}[A-Za-z]?(?:/\\d{{1,4}})?,?[{WIDE_SPACE}]*)\\z"


def token_spans(text: Column, tokens: Column) -> Column:
    """For each word piece its (start, end), found one after another in the lower-cased text without accents; null for special pieces and misses."""
    plain = F.lower(F.translate(text, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"))
    state = "struct<at:int,out:array<struct<start:int,end:int>>>"

    def step(acc: Column, token: Column) -> Column:
        piece = F.lower(F.regexp_replace(token, "^##", ""))
        found = F.call_function("locate", piece, plain, acc["at"] + 1)
        skip = (piece == "") | piece.startswith("[") | (found == 0)
        hit = F.struct((found - 1).alias("start"), (found - 1 + F.length(piece)).alias("end"))
        done = F.concat(acc["out"], F.array(F.when(~skip, hit)))
        return F.struct(F.when(skip, acc["at"]).otherwise(found - 1 + F.length(piece)).alias("at"), done.alias("out")).cast(state)

    return F.aggregate(tokens, F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(state), step, lambda acc: acc["out"])


def _gap(text: Column, a: Column, b: Column) -> Column:
    return F.substring(text, a["end"] + 1, b["start"] - a["end"])


def to_spans(text: Column, tokens: Column, entities: Column, threshold: float = 0.5, types: tuple[str, ...] | None = DEFAULT_TYPES) -> Column:
    """Spans (source ``ner``) from token entities (entity, score, index, word): same types merge over small gaps, a name inside an address joins it."""
    places = token_spans(text, tokens)
    label = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    state = "array<struct<type:string,start:int,end:int,scores:array<double>>>"

    def known(e: Column) -> Column:
        kind = F.try_element_at(label, F.regexp_replace(e["entity"], "^[BI]-", ""))
        place = F.when(e["index"] >= 1, F.try_element_at(places, e["index"].cast("int")))
        return F.struct(kind.alias("type"), place["start"].alias("start"), place["end"].alias("end"), e["score"].cast("double").alias("score"), e["entity"].startswith("I-").alias("inside"))

    used = F.filter(F.transform(entities, known), lambda e: e["type"].isNotNull() & e["start"].isNotNull() & (F.lit(True) if types is None else e["type"].isin(*types)))

    def join(acc: Column, e: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        gap = _gap(text, last, e)
        near = (last["type"] == e["type"]) & gap.rlike(f"\\A[{WIDE_SPACE},.'-]*\\z") & (e["inside"] | gap.rlike(f"\\A[{WIDE_SPACE}]*\\z") | ((e["type"] == "ADDRESS") & gap.rlike(f"\\A[{WIDE_SPACE},]*\\z")))
        longer = F.struct(last["type"].alias("type"), last["start"].alias("start"), e["end"].alias("end"), F.concat(last["scores"], F.array(e["score"])).alias("scores"))
        new = F.struct(e["type"].alias("type"), e["start"].alias("start"), e["end"].alias("end"), F.array(e["score"]).alias("scores"))
        return F.when(F.coalesce(near, F.lit(False)), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(new))).cast(state)

    def absorb(acc: Column, s: Column) -> Column:
        a, b = F.try_element_at(acc, F.lit(-2)), F.try_element_at(acc, F.lit(-1))
        small = lambda x, y: _gap(text, x, y).rlike(f"\\A[{WIDE_SPACE},]*\\z")
        inside = (F.size(acc) >= 2) & (a["type"] == "ADDRESS") & (b["type"] == "NAME") & (s["type"] == "ADDRESS") & small(a, b) & small(b, s)
        whole = F.struct(a["type"].alias("type"), a["start"].alias("start"), s["end"].alias("end"), F.concat(a["scores"], b["scores"], s["scores"]).alias("scores"))
        return F.when(F.coalesce(inside, F.lit(False)), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 2, F.lit(0))), F.array(whole))).otherwise(F.concat(acc, F.array(s))).cast(state)

    merged = F.aggregate(F.aggregate(used, F.array().cast(state), join), F.array().cast(state), absorb)

    def finished(s: Column) -> Column:
        mean = F.aggregate(s["scores"], F.lit(0.0), lambda t, v: t + v) / F.size(s["scores"])
        return span(s["type"], s["start"], s["end"], F.substring(text, s["start"] + 1, s["end"] - s["start"]), F.lit("ner"), mean)

    good = F.filter(F.transform(merged, finished), lambda s: (s["confidence"] >= threshold) & (F.length(F.trim(s["value"])) > 2))
    return F.transform(good, lambda s: F.when(s["type"] == "ADDRESS", with_house_number(text, s)).otherwise(s))


def with_house_number(text: Column, s: Column) -> Column:
    """The span with a house number that stands right before it."""
    return moved(s, s["start"] - F.length(F.regexp_extract(F.substring(text, 1, s["start"]), HOUSE, 1)), s["end"], text)


def drop_field_words(spans: Column) -> Column:
    """Names without field words at their edges; names of nothing else go."""

    def trimmed(s: Column) -> Column:
        words = F.filter(F.split(s["value"], f"[{WIDE_SPACE}]+"), lambda w: w != "")
        real = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), F.regexp_replace(F.lower(w), "[^a-z]", "").alias("k"))), lambda x: (x["k"] != "") & ~x["k"].isin(FIELD_WORDS))
        first, last = F.try_element_at(real, F.lit(1))["i"], F.try_element_at(real, F.lit(-1))["i"]
        # words and the white space after each, so that their lengths add up to places
        parts = F.regexp_extract_all(s["value"], F.lit(f"\\A[{WIDE_SPACE}]+|[^{WIDE_SPACE}]+[{WIDE_SPACE}]*"), F.lit(0))
        led = F.when(s["value"].rlike(f"\\A[{WIDE_SPACE}]"), 1).otherwise(0)
        at = F.length(F.array_join(F.slice(parts, 1, led + first), ""))
        kept = F.regexp_replace(F.array_join(F.slice(parts, led + first + 1, last - first + 1), ""), f"[{WIDE_SPACE}]+\\z", "")
        return F.when(F.size(real) > 0, span(s["type"], s["start"] + at, s["start"] + at + F.length(kept), kept, s["source"], s["confidence"]))

    out = F.transform(spans, lambda s: F.when(s["type"] == "NAME", trimmed(s)).otherwise(s))
    return F.filter(out, lambda s: s.isNotNull()).cast(SPANS)


def text_list(elements: Column) -> Column:
    """The non-empty names, texts and values of elements, in order."""
    return F.filter(F.flatten(F.transform(elements, lambda e: F.array(e["name"], e["text"], e["value"]))), lambda t: F.coalesce(t, F.lit("")) != "")


def decode_ctc(frames: Column, alphabet: Column, blank: int = 0) -> Column:
    """(text, confidence) of frames of class scores: the best class of each, repeats and blanks dropped, mean of the rest."""
    best = F.transform(frames, lambda f: F.struct(F.array_max(f).cast("double").alias("v"), (F.array_position(f, F.array_max(f)) - 1).cast("int").alias("k")))
    state = "struct<last:int,text:string,sum:double,n:int>"

    def step(acc: Column, b: Column) -> Column:
        new = (b["k"] != blank) & (b["k"] != acc["last"])
        return F.struct(b["k"].alias("last"), F.when(new, F.concat(acc["text"], F.coalesce(F.try_element_at(alphabet, b["k"] + 1), F.lit("")))).otherwise(acc["text"]).alias("text"), F.when(new, acc["sum"] + b["v"]).otherwise(acc["sum"]).alias("sum"), F.when(new, acc["n"] + 1).otherwise(acc["n"]).alias("n")).cast(state)

    start = F.struct(F.lit(-1).alias("last"), F.lit("").alias("text"), F.lit(0.0).alias("sum"), F.lit(0).alias("n")).cast(state)
    return F.aggregate(best, start, step, lambda acc: F.struct(F.trim(acc["text"]).alias("text"), F.when(acc["n"] > 0, acc["sum"] / acc["n"]).otherwise(0.0).alias("confidence")))

