"""Language dictionaries (T10): stop words and suffix rules that bring inflected forms to one lexeme.

A rule is a pattern and what it leaves; a language's rules are tried in order, each on what the one before left. Both
Spark's and SQL's expressions are made from the same table, and the same ones serve index and query. The rules are
light: they join common endings, not whole families of words. A language without a dictionary keeps its words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and what they count as.
MARKED, PLAIN = "àâäáçéèêëíîïìñóôöòúûüù", "aaaaceeeeiiiinoooouuuu"

STOP: dict[str, list[str]] = {
    "en": "a an and are as at be been but by for from had has have he her his i if in into is it its no not of on or our she so that the their them then there these they this to was we were what when which who will with you your".split(),
    "fr": "au aux avec ce ces cette dans de des du elle elles en est et eux il ils je la le les leur leurs lui ma mais me mes mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous".split(),
    "de": "aber als am an auch auf aus bei bin bis das dass dem den der des die du durch ein eine einem einen einer er es für hat ich ihr im in ist ja mit nach nicht noch nur ob oder sich sie sind so um und uns von vor war was wenn wie wir zu zum zur".split(),
    "es": "a al como con de del desde donde el ella ellos en entre era es esta este ha hasta la las le les lo los me mi muy más ni no nos o para pero por que se si sin sobre son su sus te tu un una uno y ya yo".split(),
}
DOUBLED = "".join(rf"|(.+{c}){c}" for c in "bdfgmnprt")[1:]
RULES: dict[str, list[tuple[str, str]]] = {
    "en": [
        (r"^(.+)'s?$", r"\1"),
        (r"^(.{2,})(?:ies|ied)$", r"\1y"),
        (r"^(.+(?:ss|x|ch|sh|zz))es$", r"\1"),
        (r"^(.{2,}[^su])s$", r"\1"),
        (r"^(.{4,}?)(?:ational|ation|ator)$", r"\1ate"),
        (r"^(.*[aeiouy].+?)(?:ingly|edly|fully|ings|ing|ed|ly|ness|ment)$", r"\1"),
        (rf"^(?:{DOUBLED})$", r"\1\2\3\4\5\6\7\8\9"),
        (r"^(.{2,})e$", r"\1"),
    ],
    "fr": [
        (r"^(.{2,}e)aux$", r"\1au"),
        (r"^(.{2,})aux$", r"\1al"),
        (r"^(.{3,})[sx]$", r"\1"),
        (r"^(.{3,}?)(?:issement|ement|ment|ation|ition|euse|eur|ique)$", r"\1"),
        (r"^(.{3,}?)(?:aient|erent|eraient|erait|erai|erons|eront|ions|ons|ant|ais|ait|ent|ees|ee|er|ez|es|ir|if|ive)$", r"\1"),
        (r"^(.{3,})[ei]$", r"\1"),
    ],
    "de": [
        (r"^(.{3,}?)(?:ungen|ung|heiten|heit|keiten|keit|lichen|licher|liches|liche|lich|ischen|ischer|isches|ische|isch)$", r"\1"),
        (r"^(.{3,}?)(?:erinnen|erin|esten|ester|estes|este|est|end|ten|test|tet|ern|em|en|er|es|e)$", r"\1"),
        (r"^(.{3,})[st]$", r"\1"),
    ],
    "es": [
        (r"^(.{3,}?)(?:amientos|amiento|imientos|imiento|aciones|acion|amente|mente|idades|idad)$", r"\1"),
        (r"^(.{3,}?)(?:ariamos|aremos|abamos|ieron|iendo|ando|aron|aban|aran|aria|aba|ada|adas|ado|ados|ida|idas|ido|idos|amos|emos|imos|aste|iste|are|ar|er|ir|an|en)$", r"\1"),
        (r"^(.{3,}?)(?:os|as|es|o|a|e|s)$", r"\1"),
    ],
}


def _stem(word: Column, language: str) -> Column:
    out = F.translate(word, MARKED, PLAIN)
    for pattern, left in RULES[language]:
        out = F.regexp_replace(out, pattern, left.replace("\\", "$"))
    return out


def lexeme(word: Column, language: Column) -> Column:
    """The lexeme of a lower-cased word, marked with its language; null for a stop word. The word itself where the
    language has no dictionary."""
    out = F.when(language.isNull() | ~language.isin(*RULES), word)
    for name in RULES:
        stopped = word.isin(STOP[name])
        out = out.when(language == name, F.when(~stopped, F.concat(F.lit(name + "_"), _stem(word, name))))
    return out


def stopped(word: Column, language: Column) -> Column:
    """Whether a lower-cased word is a stop word of its language's dictionary."""
    out = F.lit(False)
    for name in RULES:
        out = out | (F.coalesce(language == name, F.lit(False)) & word.isin(STOP[name]))
    return out


def lexeme_sql(word: str, language: str) -> str:
    """The same in SQL."""
    cases = ""
    for name, rules in RULES.items():
        out = f"translate({word}, '{MARKED}', '{PLAIN}')"
        for pattern, left in rules:
            out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{left}')"
        cases += f" WHEN {language} = '{name}' THEN CASE WHEN {word} NOT IN ({', '.join(repr(w) for w in STOP[name])}) THEN '{name}_' || {out} END"
    return f"CASE WHEN {language} IS NULL OR {language} NOT IN ({', '.join(repr(n) for n in RULES)}) THEN {word}{cases} END"
