"""Column functions of the complaint pipeline: guardrails, risk floor, masks, action, formats. Python runs at one place, on Arrow
batches: RE2 finds where a suspicious passage can begin.

Patterns are read as Unicode with only ``\\n`` as a line end, ``(?uUd)``, and ``i`` where case is ignored.
"""

from __future__ import annotations

import re
from functools import reduce
from re import _constants as C
from re import _parser as sre_parse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ouvidor.functions import fixed

ANY_SUSPICIOUS = "|".join(fixed.SUSPICIOUS)
#: Characters of a beginning that the gate looks at; letters that Unicode's case folding takes for an ASCII one, besides its capital.
GATE_CHARS, FOLDS = 4, {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}
#: What ``\\s`` stands for under ``(?U)``; one byte of any kind, and the most bytes of a character.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
ANY_BYTE, CHAR_BYTES = "(?s:.)", 4


def _beginnings(items: list) -> set:
    """How what a parsed pattern matches can begin: (at most GATE_CHARS characters, whether what follows them is open)."""
    found = {("", False)}
    for op, value in items:
        if op is C.LITERAL:
            part = {(chr(value).lower(), False)}
        elif op is C.IN and all(o is C.LITERAL for o, _ in value):
            part = {(chr(v).lower(), False) for _, v in value}
        elif op is C.SUBPATTERN:
            part = _beginnings(value[3])
        elif op is C.BRANCH:
            part = set().union(*(_beginnings(x) for x in value[1]))
        elif op is C.MAX_REPEAT and value[0] == 0 and value[1] == 1:
            part = {("", False)} | _beginnings(value[2])
        elif op is C.AT:
            continue
        else:
            part = {("", True)}
        found = {x if x[1] or len(x[0]) >= GATE_CHARS else ((x[0] + y[0])[:GATE_CHARS], y[1]) for x in found for y in part}
    return found


def _gate(words: set[str]) -> str:
    """A pattern for what begins with any of the words: a tree of characters, in which a complete word hides longer ones."""
    if "" in words:
        return ""
    fold = lambda x: "[" + re.escape(x) + (re.escape(x.upper()) if x.upper() != x else "") + FOLDS.get(x, "") + "]"
    tree = [(x, _gate({w[1:] for w in words if w[0] == x})) for x in sorted({w[0] for w in words})]
    branches = [fold(x) + rest for x, rest in tree]
    if len(branches) == 1:
        return branches[0]
    if len(branches) <= 6:
        return "(?:" + "|".join(branches) + ")"
    heads = lambda at: "".join(fold(x)[1:-1] for x, _ in tree[at : at + 5])
    return "(?:" + "|".join(f"(?=[{heads(at)}])(?:" + "|".join(branches[at : at + 5]) + ")" for at in range(0, len(tree), 5)) + ")"


#: The same matches as of ANY_SUSPICIOUS alone. Its forty alternatives are tried only where a text goes on as one of them begins.
GATED = "(?=" + _gate({w for w, _ in _beginnings(sre_parse.parse(ANY_SUSPICIOUS))}) + ")(?iuUd:" + ANY_SUSPICIOUS + ")"


def _one_of(chars) -> str:
    """RE2 over bytes: the UTF-8 of one of the characters, in either case."""
    chars = {f for x in chars for f in (x, x.lower(), x.upper(), *FOLDS.get(x.lower(), ""))}
    near = "".join(f"\\x{ord(x):02x}" for x in sorted(chars) if x < "\x80")
    return "(?:" + "|".join([f"[{near}]"] * bool(near) + sorted(x for x in chars if x >= "\x80")) + ")"


def _over_bytes(items: list) -> str:
    """A pattern of RE2 over bytes, of UTF-8 or not, that matches wherever the parsed one begins to, and at more places: boundaries
    are left out, a character that is not listed is any bytes, and so is an operation that is not known here."""
    out = []
    for op, value in items:
        if op is C.LITERAL:
            out.append(_one_of({chr(value)}))
        elif op is C.IN and all(o is C.LITERAL for o, _ in value):
            out.append(_one_of({chr(v) for _, v in value}))
        elif op is C.IN and value == [(C.CATEGORY, C.CATEGORY_SPACE)]:
            out.append(_one_of(SPACES))
        elif op is C.SUBPATTERN:
            out.append("(?:" + _over_bytes(value[3]) + ")")
        elif op is C.BRANCH:
            out.append("(?:" + "|".join(map(_over_bytes, value[1])) + ")")
        elif op is C.MAX_REPEAT:
            low, high, one = value[0], value[1], _over_bytes(value[2])
            if one == f"{ANY_BYTE}{{1,{CHAR_BYTES}}}":
                one, high = ANY_BYTE, high if high is C.MAXREPEAT else CHAR_BYTES * high
            out.append(f"(?:{one}){{{low},{'' if high is C.MAXREPEAT else high}}}")
        elif op in (C.ANY, C.IN, C.NOT_LITERAL):
            out.append(f"{ANY_BYTE}{{1,{CHAR_BYTES}}}")
        elif op is not C.AT:
            out.append(f"{ANY_BYTE}*")  # whatever it is, it takes some bytes or none
    return "".join(out)


MAY_BEGIN = _over_bytes(sre_parse.parse(ANY_SUSPICIOUS))


def places(pattern: str = MAY_BEGIN):
    """A function of texts to the byte from which GATED has to be tried; -1 where no passage can begin, null for a null text.

    No suspicious passage begins before the first match of ``pattern``. One character before it is kept for ``\\b``; where that is not
    an ASCII one, a combining mark say, whose base counts, the text is tried from its start.
    """

    def run(texts):
        raw = texts.cast(pa.large_binary())
        at = pc.fill_null(pc.find_substring_regex(raw, pattern), -1).to_numpy(zero_copy_only=False).astype("int32")
        rows = np.flatnonzero(at > 0)
        if len(rows):
            begins = np.frombuffer(raw.buffers()[1], dtype="int64")[raw.offset : raw.offset + len(raw)]
            before = np.frombuffer(raw.buffers()[2], dtype="uint8")[begins[rows] + at[rows] - 1]
            at[rows] = np.where(before < 128, at[rows] - 1, 0)
        return pa.array(at, mask=pc.is_null(raw).to_numpy(zero_copy_only=False))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return run


def suspicious_match(text: Column) -> Column:
    """The first suspicious passage; '' if there is none, null for a null text.

    RE2 reads the texts, in one pass whatever the number of alternatives; the pattern itself, which decides, is tried from where RE2 stopped.
    """
    at = F.arrow_udf(places(), returnType="int")(text)
    rest = F.substring(text.cast("binary"), at + 1, F.octet_length(text)).cast("string")
    return F.regexp_extract(F.when(at < 0, "").otherwise(rest), GATED, 0)


def block_reason(text: Column, match: Column | None = None) -> Column:
    """Reason of a block, or of a failure (null text); null for a text that goes on."""
    m = suspicious_match(text) if match is None else match
    return F.when(text.isNull(), fixed.ERROR_PREFIX + "texto nulo").when(m != "", F.concat(F.lit(fixed.REASON_PREFIX), F.substring(m, 1, fixed.REASON_CHARS)))


def risk_trigger(text: Column) -> Column:
    """The first trigger of the list that the text contains; null if none. The text is an array's one element, so it is lowered once for all triggers."""
    first = lambda lower: F.coalesce(*[F.when(F.contains(lower, F.lit(t)), F.lit(t)) for t in fixed.TRIGGERS])
    return F.transform(F.array(F.lower(text)), first)[0]


def risk_level(channel: Column, trigger: Column) -> Column:
    return F.when(channel.isin(fixed.REGULATORS), fixed.RISK_CHANNEL[0]).when(trigger.isNotNull(), fixed.RISK_TRIGGER[0]).otherwise(fixed.RISK_NONE[0])


def risk_reason(channel: Column, trigger: Column) -> Column:
    found = F.concat(F.lit(fixed.RISK_TRIGGER[1]), trigger, F.lit(fixed.RISK_TRIGGER[2]))
    return F.when(channel.isin(fixed.REGULATORS), fixed.RISK_CHANNEL[1]).when(trigger.isNotNull(), found).otherwise(fixed.RISK_NONE[1])


def action(urgency: Column, level: Column, sources: Column | None = None) -> Column:
    """Recommended action; ``sources``: array of chunk ids."""
    by_urgency = reduce(lambda c, kv: c.when(urgency == kv[0], kv[1]), list(fixed.ACTIONS.items())[1:], F.when(urgency == next(iter(fixed.ACTIONS)), next(iter(fixed.ACTIONS.values())))).otherwise(fixed.ACTION_ELSE)
    source = F.lit(fixed.ACTION_NO_SOURCE)
    if sources is not None:
        source = F.when(F.size(sources) > 0, F.concat(F.lit(fixed.ACTION_SOURCES), F.array_join(sources, ", "), F.lit("."))).otherwise(source)
    return F.concat(by_urgency, source, F.when(level.isin("Alto", "Crítico"), fixed.ACTION_ESCALATE).otherwise(""))


def mask_personal(text: Column) -> Column:
    text = F.regexp_replace(text, "(?uUd)" + fixed.CPF, "[CPF]")
    text = F.regexp_replace(text, "(?iuUd)" + fixed.ACCOUNT, "[CONTA]")
    return F.regexp_replace(text, "(?uUd)" + fixed.PHONE, "[TELEFONE]")


def mask_profanity(text: Column) -> Column:
    return reduce(lambda t, w: F.regexp_replace(t, f"(?iuUd)({w[0]}){w[1:]}", "$1" + "*" * (len(w) - 1)), fixed.PROFANITIES, text)


def mask_output(text: Column) -> Column:
    return mask_profanity(mask_personal(text))


def mask_text(text: str) -> str:
    """mask_output() of one text, for what a model's answer brings before it is validated."""
    text = re.sub(fixed.PHONE, "[TELEFONE]", re.sub(fixed.ACCOUNT, "[CONTA]", re.sub(fixed.CPF, "[CPF]", text), flags=re.IGNORECASE))
    return reduce(lambda t, w: re.sub(f"({w[0]}){w[1:]}", lambda m: m[1] + "*" * (len(w) - 1), t, flags=re.IGNORECASE), fixed.PROFANITIES, text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?uU)^\s+|\s+$", "")


def escape_html(text: Column) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")], text)


def format_cost(value: Column) -> Column:
    """BRL with two decimals, four where less than a cent would show as nothing."""
    return F.when((value != 0) & (F.abs(value) < 0.01), F.format_string("R$ %.4f", value)).otherwise(F.format_string("R$ %.2f", value))


# The same in SQL for the oracles.
def sql_lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


SQL_MATCH = f"regexp_extract(texto, {sql_lit(ANY_SUSPICIOUS)}, 0, 'i')"
SQL_REASON = f"CASE WHEN texto IS NULL THEN {sql_lit(fixed.ERROR_PREFIX + 'texto nulo')} WHEN m <> '' THEN {sql_lit(fixed.REASON_PREFIX)} || substr(m, 1, {fixed.REASON_CHARS}) END"
SQL_TRIGGER = "CASE " + " ".join(f"WHEN contains(lower(texto), {sql_lit(t)}) THEN {sql_lit(t)}" for t in fixed.TRIGGERS) + " END"
_REGULATOR = "canal IN (" + ", ".join(map(sql_lit, fixed.REGULATORS)) + ")"
SQL_LEVEL = f"CASE WHEN {_REGULATOR} THEN {sql_lit(fixed.RISK_CHANNEL[0])} WHEN gatilho IS NOT NULL THEN {sql_lit(fixed.RISK_TRIGGER[0])} ELSE {sql_lit(fixed.RISK_NONE[0])} END"
SQL_JUST = f"CASE WHEN {_REGULATOR} THEN {sql_lit(fixed.RISK_CHANNEL[1])} WHEN gatilho IS NOT NULL THEN {sql_lit(fixed.RISK_TRIGGER[1])} || gatilho || {sql_lit(fixed.RISK_TRIGGER[2])} ELSE {sql_lit(fixed.RISK_NONE[1])} END"


def sql_action(urgency: str, level: str, sources: str | None = None) -> str:
    """``sources``: chunk ids in one string, null for none."""
    cases = " ".join(f"WHEN {urgency} = {sql_lit(k)} THEN {sql_lit(v)}" for k, v in fixed.ACTIONS.items())
    source = sql_lit(fixed.ACTION_NO_SOURCE)
    if sources:
        source = f"CASE WHEN {sources} IS NULL THEN {source} ELSE {sql_lit(fixed.ACTION_SOURCES)} || {sources} || '.' END"
    return f"(CASE {cases} ELSE {sql_lit(fixed.ACTION_ELSE)} END || {source} || CASE WHEN {level} IN ('Alto', 'Crítico') THEN {sql_lit(fixed.ACTION_ESCALATE)} ELSE '' END)"


def sql_mask_personal(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({x}, {sql_lit(fixed.CPF)}, '[CPF]', 'g'), {sql_lit(fixed.ACCOUNT)}, '[CONTA]', 'gi'), {sql_lit(fixed.PHONE)}, '[TELEFONE]', 'g')"


def sql_mask_profanity(x: str) -> str:
    return reduce(lambda t, w: f"regexp_replace({t}, '({w[0]}){w[1:]}', '\\1{'*' * (len(w) - 1)}', 'gi')", fixed.PROFANITIES, x)
