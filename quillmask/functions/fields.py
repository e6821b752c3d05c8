"""Rules on form fields: which type of value a field holds, accepts or is hinted to want."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmask.functions.text import ascii_edges, blank, split_identifiers

# Label patterns and the type each stands for; the first that fits wins.
LABELS = (
    ("\\b(otp|one[\\s_-]?time)\\b|verification[\\s_-]?code", "OTP"),
    ("\\bcvv2?\\b|\\bcvc\\b|security[\\s_-]?code", "CVV"),
    ("\\bm?pin\\b(?![\\s_-]?code)", "PIN"),
    ("aadha+r|\\buid(ai)?\\b", "AADHAAR"),
    ("\\bpan\\b(?![\\s_-]?code)|pan[\\s_-]?(no|number|card)|permanent[\\s_-]?account[\\s_-]?(no|number)", "PAN"),
    ("\\bifsc\\b", "IFSC"),
    ("\\b(account|acct|a/c)[\\s_-]*(no|num|number)?\\b", "ACCOUNT"),
    ("\\bdob\\b|date[\\s_-]?of[\\s_-]?birth|birth[\\s_-]?date", "DOB"),
    ("pin[\\s_-]?code|postal[\\s_-]?code|\\bzip(code)?\\b", "PINCODE"),
    ("card[\\s_-]?(no|num|number)|\\bcc[\\s_-]?num", "CARD"),
    ("password|passwd|\\bpwd\\b|passcode", "PASSWORD"),
    ("api[\\s_-]?key|secret|token", "SECRET"),
)
# Hints by which a planner picks the token type for a field's label.
HINTS = (
    ("aadha+r|\\buid\\b", "AADHAAR"), ("\\bpan\\b", "PAN"), ("ifsc", "IFSC"), ("\\bupi\\b|vpa", "UPI"), ("e-?mail", "EMAIL"),
    ("phone|mobile|\\btel\\b|contact no", "PHONE"), ("gstin|\\bgst\\b", "GSTIN"), ("passport", "PASSPORT"), ("card", "CARD"),
    ("account", "ACCOUNT"), ("birth|\\bdob\\b", "DOB"), ("pin ?code|postal|\\bzip\\b", "PINCODE"), ("address", "ADDRESS"), ("name", "NAME"),
)
# Keywords by which evaluations label fields on their own; null where a field counts as none.
TRUTH = (
    ("captcha|security code|verification code shown|search", None), ("e-?mail", "EMAIL"), ("aadha?ar|\\buid\\b|vid\\b", "AADHAAR"),
    ("\\bpan\\b|pan card|pan number|pan no", "PAN"), ("ifsc", "IFSC"), ("card number|card no|cardnumber", "CARD"),
    ("account (number|no)|acc(ount)?_?no", "ACCOUNT"), ("\\botp\\b|one.time", "OTP"),
    ("mobile|phone|contact (number|no)|whatsapp|\\btel\\b", "PHONE"), ("date of birth|\\bdob\\b|birth ?date|bday", "DOB"),
    ("pin ?code|postal|zip", "PINCODE"), ("address|street|locality|house|flat", "ADDRESS"), ("user ?name|login id|user id", None), ("name", "NAME"),
)
UNTYPED_INPUTS = "checkbox radio submit button file hidden image reset range color search".split()


def _first(text: Column, table: tuple, none: str = "-") -> Column:
    out = F.lit(None).cast("string")
    for pattern, kind in reversed(table):
        out = F.when(text.rlike("(?i)" + ascii_edges(pattern)), F.lit(kind or none)).otherwise(out)
    return F.when(out != none, out)


def _joined(*parts: Column) -> Column:
    return F.concat_ws(" ", *(F.when(~blank(p), p) for p in parts))


def _low(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def dom_rule_type(input_type: Column, autocomplete: Column, name: Column, html_id: Column, label: Column, placeholder: Column) -> Column:
    """The type that a field's own attributes name, else null."""
    kind, auto = _low(input_type), _low(autocomplete)
    return (
        F.when(kind == "password", "PASSWORD")
        .when(auto.contains("one-time-code"), "OTP")
        .when(auto == "cc-csc", "CVV")
        .when(auto.startswith("cc-"), "CARD")
        .when((auto == "bday") | auto.startswith("bday-"), "DOB")
        .when(auto == "postal-code", "PINCODE")
        .otherwise(_first(split_identifiers(_joined(name, html_id, label, placeholder)), LABELS))
    )


def accepted_types(rule: Column, input_type: Column, autocomplete: Column) -> Column:
    """The token types that may be typed into a field; null stands for any."""
    kind, auto = F.lower(F.coalesce(input_type, F.lit("text"))), _low(autocomplete)
    return F.when(rule.isNotNull(), F.array(rule)).when((kind == "email") | (auto == "email"), F.array(F.lit("EMAIL"))).when((kind == "tel") | auto.startswith("tel"), F.array(F.lit("PHONE")))


def wanted_type(field_type: Column, label: Column) -> Column:
    """The token type that a planner looks for."""
    return F.when(field_type == "email", "EMAIL").when(field_type == "tel", "PHONE").otherwise(_first(F.coalesce(label, F.lit("")), HINTS))


def truth_type(tag: Column, input_type: Column, disabled: Column, name: Column, html_name: Column, html_id: Column, placeholder: Column, autocomplete: Column) -> Column:
    """The type an evaluation gives a field, by keywords of its own."""
    kind = F.lower(F.coalesce(input_type, F.lit("text")))
    words = F.lower(_joined(name, html_name, html_id, placeholder, autocomplete))
    usable = tag.isin("input", "textarea") & ~kind.isin(UNTYPED_INPUTS) & ~F.coalesce(disabled, F.lit(False))
    found = _first(words, TRUTH)
    # the field's kind counts as a telephone where the keywords for it would
    tel = (kind == "tel") & ~_first_before_phone(words)
    return F.when(usable, F.when(kind == "password", "PASSWORD").when(tel, "PHONE").otherwise(found))


def _first_before_phone(words: Column) -> Column:
    """Whether a keyword that comes before the telephone's decides."""
    at = next(i for i, (_, kind) in enumerate(TRUTH) if kind == "PHONE")
    return words.rlike("(?i)" + ascii_edges("|".join(f"(?:{p})" for p, _ in TRUTH[:at])))
