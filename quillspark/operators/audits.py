"""What an auditor's reply says of an output, as one native Column: JSON by schema, and what a reply that was cut still holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import lexicons
from quillspark.operators.dictionary import MARK

REPLY = "fidelity array<string>, style array<string>, problems array<string>"
OBJECTION = "passage string, problem string, right string"
#: A wanted text of fewer letters says nothing by being in the output.
TELLING = 4


def plain(text: Column) -> Column:
    """Lower case; what is no letter or digit is a space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[\W_]+", " "))


def _objection(given: Column) -> Column:
    """An objection as it is shown (text) and what it wants instead (right): an object's fields, or a string as it is."""
    own = F.from_json(F.when(F.startswith(F.trim(given), F.lit("{")), given), OBJECTION)
    field = lambda name: F.coalesce(own[name], F.lit(""))
    hint = F.when(field("right") != "", F.concat(F.lit(" (suggestion: "), own["right"], F.lit(")"))).otherwise("")
    shown = F.concat(F.lit("“"), field("passage"), F.lit("”: "), field("problem"), hint)
    return F.struct(F.when(own.isNull(), given).otherwise(shown).alias("text"), plain(own["right"]).alias("right"))


def _stands(objection: Column, output: Column) -> Column:
    """Whether an objection holds: the output does not say already what it wants, it concedes nothing, and it does not judge the author's words."""
    said = (F.length(objection["right"]) >= TELLING) & F.contains(output, objection["right"])
    moral = objection["text"].rlike(lexicons.MORALISES) & ~objection["text"].rlike(lexicons.SOFTENS)
    return ~(said | objection["text"].rlike(lexicons.CONCEDES) | moral)


def verdict(reply: Column, output: Column) -> Column:
    """struct<faithful: boolean, problems: array<string>> of a reply on ``output``. Objections that stand are grave; others, and remarks of style, are named as such. An older
    form says ``ok``. Of a reply cut within its list, the objections that are whole count. Anything else is no valid reply. Null replies are empty ones."""
    reply = F.coalesce(reply, F.lit(""))
    none = F.array().cast("array<string>")
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    keys = F.coalesce(F.json_object_keys(body), none)
    data = F.from_json(body, REPLY)
    shown = plain(F.regexp_replace(F.coalesce(output, F.lit("")), MARK, " "))
    tagged = F.transform(F.transform(F.coalesce(data["fidelity"], none), _objection), lambda o: F.struct(o["text"].alias("text"), _stands(o, shown).alias("stands")))
    texts = lambda rows: F.transform(rows, lambda o: o["text"])
    grave = texts(F.filter(tagged, lambda o: o["stands"]))
    lifted = F.filter(texts(tagged), lambda t: ~F.array_contains(grave, t))
    remarks = F.concat(F.coalesce(data["style"], none), F.transform(lifted, lambda t: F.concat(F.lit("(named, but not upheld) "), t)))
    answer = lambda faithful, problems: F.struct(faithful.alias("faithful"), problems.alias("problems"))
    judged = answer(F.size(grave) == 0, F.concat(grave, F.transform(remarks, lambda r: F.concat(F.lit("style: "), r))))

    said = F.get_json_object(body, "$.ok")
    former = answer(F.coalesce(~said.isin("false", "0", "", "null", "[]", "{}"), F.lit(False)), F.coalesce(data["problems"], none))

    items = F.transform(F.regexp_extract_all(F.substring_index(reply, '"fidelity"', -1), F.lit(r"\{[^{}]*\}"), F.lit(0)), lambda x: F.from_json(x, OBJECTION))
    whole = F.filter(items, lambda o: o["passage"].isNotNull() & o["problem"].isNotNull() & ~o["problem"].rlike(lexicons.CONCEDES))
    listed = F.transform(whole, lambda o: F.concat(F.lit("“"), o["passage"], F.lit("”: "), o["problem"]))
    cut = answer(F.size(listed) == 0, listed)
    empty = reply.rlike(r'"fidelity"\s*:\s*\[\s*\]')
    invalid = answer(F.lit(False), F.array(F.concat(F.lit("no valid reply: "), F.substring(reply, 1, 120))))
    return F.when(F.array_contains(keys, "fidelity"), judged).when(F.array_contains(keys, "ok"), former).when(F.contains(reply, F.lit('"fidelity"')) & ((F.size(listed) > 0) | empty), cut).otherwise(invalid)
