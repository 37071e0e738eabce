"""Broken prompt and response pairs: a pushdown parser, string tiling, script and language checks, refusal grammars."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.runtime import cut_lineage

#: Placeholders and labels that say nothing, once brackets and marks are off.
NOTHING = {"null", "none", "nil", "na", "n a", "nan", "empty", "blank", "undefined", "no answer", "no response", "answer", "response", "reply", "result", "output", "tbd", "todo", "tba", "antwort", "keine antwort", "leer", "réponse", "sans réponse", "pas de réponse", "vide", "respuesta", "sin respuesta", "vacío", "no content", "no text", "assistant", "text"}
#: Labels that may stand around a repeated question.
LABELS = {"question", "q", "frage", "pregunta", "the", "is", "was", "you", "asked", "your", "user", "repeat", "la", "die", "asks", "prompt", "a", "answer", "antwort", "réponse", "respuesta"}
#: Function words by language; they decide the language and cannot end a sentence.
FUNCTION = {
    "en": set("the of and to in was were is are with by for on at from that this which who whom whose it its as an a be been has had have not but or when while after before because however although into over under between during about how many what where why does did do name one other they their them he she his her said then than also each only later".split()),
    "fr": set("le la les des du de un une et est dans par pour sur avec qui que quoi où au aux ce cette ces il elle ils sont été était a ont pas plus mais ou donc ne se sa son ses leur quand après avant selon pendant combien quelle quel jusqu en entre sans comme très fut".split()),
    "es": set("el la los las de del un una y en es fue por para con que quién qué dónde cuál cuánto al se su sus lo como más pero o no le ha han había sido durante según cuando después antes hasta entre sin sobre este esta esa ese muy todo mundo año primera".split()),
    "de": set("der die das den dem des ein eine einen einem einer und ist war wurde wurden in im am zum zur von mit für auf bei nach vor aus an als auch nicht sich es er sie ihr sein hat haben hatte wer wie wo wann welches welcher welche welchem wegen bis über unter durch dass weil nachdem während laut viel diesem dieser diese noch ihm sind".split()),
}
#: Words of English that end complete answers as well ("later", "them").
MAY_END = set("they them it he she her his later other one many name said each then also only over before after about into under not do did does how what where why mundo todo año es muy no primera viel auch an auf aus ein bei nach vor durch été pas plus très".split())
MATERIAL = r"(?:dossier|context|passages?|excerpts?|records?|material|documents?|sources?|text|archive|files?)"
#: What material does or fails to do when it is said to answer; "the documents do not survive" is a story.
SAYING = r"(?:say|state|mention|specify|contain|give|name|provide|include|indicate|identify|record|tell|reveal|cover|list|answer|address|disclose|note|report|offer|explain|describe|show|have|hold|help|discuss|supply|allow|support|touch|refer|speak|clarify|establish|confirm|settle)"
REFUSAL = [
    re.compile(p, re.I)
    for p in (
        r"\bI(?:'m| am| was|'ve| have)? (?:\w+ ){0,3}?(?:cannot|can't|can not|could not|couldn't|unable|not able|don't know|do not know|won't|will not|decline|am not allowed|not permitted|rather not|prefer not)\b",
        r"\bI(?:'m| am) (?:\w+ )?(?:unable|not able|not allowed|afraid|sorry)\b",
        r"\bI (?:must|have to|would|should|do|did|can|could|may) (?:\w+ ){0,2}?(?:decline|refuse|not (?:say|answer|comment|know|have|find|tell|see))\b",
        r"\bI (?:apologi[sz]e|regret|have no|found no|find no|see no|know nothing)\b",
        r"^\W*(?:sorry|apologies|unfortunately|regrettably)\b.*\b(?:cannot|can't|not|no|lacks?|unable|insufficient|silent)\b",
        rf"\b{MATERIAL} (?:\w+ ){{0,4}}?(?:does not|do not|doesn't|don't|did not|didn't|fails? to|never|nowhere) (?:\w+ ){{0,2}}?{SAYING}\b",
        rf"\b{MATERIAL} (?:\w+ ){{0,4}}?(?:lacks?|makes? no|gives? no|has no|have no|contains? no|offers? no|provides? no|is silent|are silent|says? nothing)\b",
        r"\b(?:is|are|was|were|isn't|aren't|wasn't) ?(?:not |n't )?(?:\w+ )?(?:stated|mentioned|specified|contained|given|found|included|covered|recorded|named|available|provided)?(?: anywhere)? in the (?:\w+ )?(?:dossier|context|passages?|excerpts?|records?|material|documents?|sources?)\b.*",
        r"\b(?:no|insufficient|not enough) (?:\w+ )?(?:information|answer|context|data|details?|evidence|mention)\b",
        r"^\W*not (?:\w+ ){0,2}?(?:in|found in|stated in|mentioned in|given in|covered by) the (?:\w+ )?(?:dossier|context|passages?|excerpts?|records?|material|documents?|sources?)",
        r"\b(?:outside|beyond) (?:what|the|my)\b.*\b(?:allowed|scope|material|discuss|remit)\b",
        r"\b(?:request|question) (?:falls|is|lies|goes) (?:outside|beyond)\b",
        r"\bkann ich\b.*\bnicht\b", r"\bich (?:kann|darf|möchte|will)\b.*\b(?:nicht|keine)\b", r"\bich (?:weiß|habe|finde)\b.*\b(?:nicht|keine|nichts)\b",
        r"\bliegen (?:mir|uns|hier)? ?keine\b", r"\b(?:enthält|enthalten|nennt|nennen|erwähnt|erwähnen|gibt|geben|sagt|sagen)\b.*\b(?:nicht|keine|nichts)\b.*(?:angabe|auskunft|information|dossier|kontext|auszüge|frage|dazu|darüber|nicht)", r"\b(?:dossier|kontext|auszüge\w*|unterlagen|material)\b.*\b(?:nicht|keine|nichts)\b",
        r"\bje (?:ne|n')", r"\b(?:dossier|contexte|extraits?|documents?|passages?)\b (?:\w+ ){0,2}?(?:ne|n')\b", r"\b(?:ne contient pas|ne contiennent pas|ne mentionnent? pas|ne précisent? pas|aucune (?:information|donnée|mention|réponse)|impossible de (?:répondre|dire))\b", r"^\W*désolé",
        r"^\W*lo siento", r"\bno (?:puedo|sé|dispongo|tengo|encuentro|debo|quiero|conozco)\b", r"\bno (?:\w+ )?(?:contienen?|mencionan?|indican?|dicen?|figura|aparece|consta|recogen?)\b.*", r"\b(?:no hay|sin|ninguna?) (?:\w+ )?(?:información|datos|respuesta|mención)\b", r"\bdesconozco\b",
        r"^\W*(?:mi dispiace|spiacente|purtroppo)\b", r"\bnon (?:posso|so|sono in grado|dispongo|ho|trovo)\b", r"\b(?:dossier|contesto|documenti?|materiale) (?:\w+ ){0,2}?non\b",
        r"^\W*(?:desculpe|lamento|infelizmente)\b", r"\bnão (?:posso|sei|tenho|consigo|encontro)\b", r"^\W*helaas\b", r"\bik (?:kan|weet|mag|vind)\b.*\b(?:niet|geen)\b",
    )
]
#: A refusal is about the speaker or the material; this cancels the wide pattern of "is ... in the dossier" without a negation.
NEGATION = re.compile(r"\b(?:not|n't|no|nothing|nowhere|never|isn't|aren't|wasn't|cannot|can't|don't|doesn't|couldn't|won't|decline|rather|unable|sorry|afraid|apologi[sz]e|regret\w*|lacks?|silent|insufficient|outside|beyond|fails?|refuse|nicht|keine\w*|nichts|ne|n'\w+|aucun\w*|impossible|désolé|siento|ningun\w*|sin|desconozco|non|dispiace|spiacente|não|desculpe|lamento|infelizmente|niet|geen|helaas)\b|n't|\bn'", re.I)

CITE = r"(?:\[\s*\d+(?:\s*[,;–-]\s*\d+)*\s*\]|\(see passages? \d+\)|【\d+】)"
TRAILING = re.compile(rf"(?:\s*(?:{CITE}|(?:sources?|quellen?|fuentes?)\s*:\s*{CITE}(?:\s*,?\s*{CITE})*)\s*[.,;]?)+\s*$", re.I)
TERMINAL = set(".!?…。！？")
CLOSERS = "\"'”’»)]}*_`）」』"
#: Brackets and quotations, each with what closes it; tags whose end must be written, and tags without one.
PAIRED = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "（": "）", "「": "」", "『": "』", "„": "“”"}
TAGS = {"a", "b", "blockquote", "code", "div", "em", "h1", "h2", "h3", "h4", "i", "ol", "pre", "q", "s", "span", "strong", "sub", "sup", "table", "u", "ul"}
LATE = {"p", "li", "td", "th", "tr", "dt", "dd"}
LEXEME = re.compile(r"(?m)^[ \t]*(?P<fence>`{3,}|~{3,})[^\n]*$|(?P<code>`+)|<(?P<shut>/?)(?P<tag>[A-Za-z][A-Za-z0-9]*)(?P<rest>[^<>]*)>|(?P<bullet>^[ \t]*[*+-][ \t])|(?P<mark>\*\*|__|\*|_)|(?P<sign>[()\[\]{}“”„«»（）「」『』\"])")
ITEM = re.compile(r"^[ \t]*(?:\d+[.)]|[-*+•–])[ \t]+(?=\S)")


#: Beginnings of up to so many letters are listed for each known word; longer ones are found in its order.
LISTED = 24
HIDDEN = regex.compile(r"[\p{Cf}\p{Co}\p{Cn}\p{Cs}]|(?![\n\t\r])\p{Cc}")


def visible(text: str | None) -> str:
    """The text without invisible characters, ends trimmed."""
    if not text:
        return ""
    kept = HIDDEN.sub("", text)
    return kept.replace("\r\n", "\n").replace(" ", " ").strip()


def question_of(prompt: str | None) -> str:
    """All that follows the line QUESTION, or, without one, the line ### user; else the whole prompt."""
    text = (prompt or "").replace("\r\n", "\n")
    for mark in (r"(?m)^[ \t]*QUESTION[ \t]*$", r"(?m)^[ \t]*### user[ \t]*$"):
        found = list(re.finditer(mark, text))
        if found:
            return text[found[-1].end() :].strip()
    return text.strip()


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def is_empty(text: str) -> bool:
    bare = re.sub(CITE, " ", text)
    left = words(bare)
    return not left or " ".join(left) in NOTHING or (len(left) <= 6 and all(w in NOTHING or w in {"no", "sans", "sin", "keine"} for w in left) and any(w in NOTHING for w in left))


def tiles(a: list[str], b: list[str], least: int) -> int:
    """Words of a that greedy string tiling covers with stretches of b, longest first, none shorter than ``least``."""
    free_a, free_b, total = [True] * len(a), [True] * len(b), 0
    places: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        places.setdefault(w, []).append(j)
    while True:
        best = (0, 0, 0)
        for i, w in enumerate(a):
            if len(a) - i <= best[0]:
                break
            for j in places.get(w, ()):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < max(1, least):
            return total
        free_a[i : i + n] = [False] * n
        free_b[j : j + n] = [False] * n
        total += n


def copies(question: str, answer: str) -> bool:
    """Whether the answer is the question again, as often as it likes, with labels and marks at most."""
    q, a = words(question), words(re.sub(CITE, " ", answer))
    if not q or not a:
        return False
    while len(a) > len(q) and a[: len(q)] == q and a[len(q) :] and tiles(a[len(q) :], q, 3) == len(a) - len(q):
        a = a[len(q) :]
    extra = [w for w in a if w not in set(q)]
    if len(a) > 2 * len(q) + 8 or any(w not in LABELS for w in extra) or sum(w.isdigit() for w in a) > sum(w.isdigit() for w in q):
        return False
    return tiles(a, q, min(3, len(q))) >= max(1, round(0.9 * len(q)), len(a) - 4)


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?。！？])\s+|\n+", text) if s.strip()]


def refuses(answer: str) -> bool:
    """Whether the first sentence declines, or says that the material does not say; quoted words do not count."""
    bare = re.sub(r"\"[^\"]*\"|“[^”]*”|«[^»]*»", " ", re.sub(CITE, " ", answer)).replace("’", "'")
    bare = re.sub(r"^\W*(?:answer|antwort|réponse|respuesta)\s*:\s*", "", bare, flags=re.I)
    parts = sentences(bare)
    return bool(parts) and bool(NEGATION.search(parts[0])) and any(p.search(parts[0]) for p in REFUSAL)


#: Of each function word its languages, and what it counts for them: a word of one language alone counts three times.
SPOKEN = {w: ([k for k, v in FUNCTION.items() if w in v], 3 if sum(w in v for v in FUNCTION.values()) == 1 else 1) for v in FUNCTION.values() for w in v}
QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|«[^»]*»|「[^」]*」")
NAMED = re.compile(r"(?<![.!?\n-] )(?<![¿¡\n])(?<!^)\b[A-ZÀ-Þ][\w'’-]*:?(?:\s+(?:of the|of|the|[A-ZÀ-Þ0-9][\w'’-]*:?))*")
LETTERS = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=4096)
def language(text: str) -> dict[str, int]:
    """Function words by language; quotations, titles and names are left out. The same question is asked at many stages, so it is remembered."""
    bare = NAMED.sub(" ", QUOTED.sub(" ", text))
    found = dict.fromkeys(FUNCTION, 0)
    for w in LETTERS.findall(bare.lower()):
        told = SPOKEN.get(w)
        if told is not None:
            for k in told[0]:
                found[k] += told[1]
    return found


@lru_cache(maxsize=65_536)
def script_of(c: str) -> str:
    """The script of a letter by its name; the scripts that Japanese mixes count as one."""
    name = unicodedata.name(c, "OTHER").split(" ")[0]
    return "CJK" if name in ("HIRAGANA", "KATAKANA", "CJK") else name


@lru_cache(maxsize=4096)
def script(text: str) -> str:
    """The script a text is written in: the most frequent other one if it makes a fourth of the letters, else LATIN; quotations do not count."""
    bare = QUOTED.sub(" ", text)
    if bare.isascii():
        return "LATIN"
    rest = re.sub(r"[A-Za-zÀ-ɏ]+", "", bare)
    latin = len(bare) - len(rest)
    kinds = Counter(script_of(c) for c in rest if c.isalpha())
    kinds.pop("LATIN", None)
    other = sum(kinds.values())
    return kinds.most_common(1)[0][0] if other >= 4 and other * 3 >= latin else "LATIN"


def wrong_language(question: str, answer: str) -> bool:
    if script(question) != script(answer):
        return True
    asked, got = language(question), language(answer)
    mine = max(asked, key=asked.get)
    if asked[mine] < 2:
        return False
    theirs = max(got, key=got.get)
    return theirs != mine and got[theirs] >= 5 and got[theirs] >= 2 * got[mine] + 2


def left_open(text: str) -> bool:
    """Pushdown parse: whether a fence, code, tag, emphasis, bracket or quotation is still open at the end.

    A closer takes everything off the stack down to its opener; one without an opener is plain text.
    Nothing is parsed inside code. Emphasis opens before and closes after a character that is not
    blank, never inside a word; a list's bullet is no emphasis, a figure's inch mark no quotation.
    """
    stack: list[str] = []

    def close(what: str) -> bool:
        if what not in stack:
            return False
        del stack[len(stack) - 1 - stack[::-1].index(what) :]
        return True

    for m in LEXEME.finditer(text):
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        kind = m.lastgroup if m.lastgroup != "rest" else "tag"
        if m["fence"] or m["code"]:
            what = (m["fence"] or m["code"])[:3]
            inside = next((x for x in stack if x[0] in "`~"), None)
            if inside is None:
                stack.append(what)
            elif inside == what:
                close(what)
        elif any(x[0] in "`~" for x in stack) or kind == "bullet":
            continue
        elif m["tag"]:
            name = m["tag"].lower()
            if m["shut"]:
                close(f"<{name}")
            elif name in TAGS | LATE and not m["rest"].rstrip().endswith("/"):
                stack.append(f"<{name}")
        elif m["mark"]:
            left, right = bool(before.strip()), bool(after.strip())
            if before == m["mark"][0] or after == m["mark"][0] or before.isalnum() and after.isalnum():
                continue
            if not (left and close(m["mark"])) and right and not before.isalnum():
                stack.append(m["mark"])
        else:
            c = m["sign"]
            if c == '"':
                if not close(c) and not (before.isdigit() and not after.isalnum()):
                    stack.append(c)
            elif not any(c in PAIRED[x] and close(x) for x in reversed([y for y in stack if y in PAIRED])) and c in PAIRED:
                stack.append(c)
    return any(x[1:] not in LATE for x in stack) or bool(re.search(r"</?[A-Za-z][^<>]*$", text))


def listed(text: str) -> bool:
    """Whether the text ends in a list of two items or more none of which ends like a sentence."""
    items = [x for x in text.split("\n") if ITEM.match(x)]
    return len(items) > 1 and bool(ITEM.match(text.split("\n")[-1])) and not any(x.rstrip().rstrip(CLOSERS)[-1:] in TERMINAL for x in items)


def ending(answer: str) -> tuple[bool, str]:
    """(truncated, word): whether the answer breaks off; word is the last word if only a vocabulary can tell."""
    text = answer.rstrip()
    if left_open(text):
        return True, ""
    lines = text.split("\n")
    if re.fullmatch(r"\s*(?:`{3,}|~{3,})\s*", lines[-1]):  # a closed fence ends an answer
        return False, ""
    if len(lines) > 1 and re.fullmatch(r"\s*(?:\d+[.)]|[-*•–])\s*", lines[-1]):
        return True, ""
    cited = TRAILING.search(text)
    bare = TRAILING.sub("", text).rstrip()
    core = bare.rstrip(CLOSERS)
    if not core:
        return False, ""
    if core[-1] in ",;:–—-&/=" or core.endswith(("(", "[")):
        return True, ""
    last = re.search(r"[^\W_]+(?:['’-][^\W_]+)*$", core)
    if core[-1] in TERMINAL:
        trailing = re.search(r"([^\W_]+)\s*(?:\.{3,}|…)$", core)
        return bool(trailing), ""
    if not last:
        return False, ""
    word = last.group()
    low = word.lower()
    if re.search(r"\d", word):
        number = re.search(r"\d[\d,]*$", core)
        bad = number and "," in number.group() and not re.fullmatch(r"\d{1,3}(?:,\d{3})*", number.group())
        return bool(bad), ""
    if low not in MAY_END and any(low in v for v in FUNCTION.values()) and not cited:
        return True, ""
    if cited:
        return False, ""
    if (len(sentences(bare)) > 1 or "\n" in bare) and not listed(bare):
        return True, ""
    if low in MAY_END:
        return low in {"it", "he", "she", "his", "her", "they", "into", "under", "also", "then", "only", "ein", "auch", "an", "auf", "aus", "bei", "nach", "vor", "durch"}, ""
    return False, low


def judge(prompt: str | None, answer: str | None) -> tuple[str | None, str]:
    """(defect, open word): the defect, or none and perhaps the last word, which a vocabulary must know."""
    text = visible(answer)
    if is_empty(text):
        return "empty", ""
    question = visible(question_of(prompt))
    if copies(question, text):
        return "copies_question", ""
    if refuses(text):
        return "refusal", ""
    if wrong_language(question, text):
        return "wrong_language", ""
    cut, word = ending(text)
    return ("truncated" if cut else None), word


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [judge(p, a) for p, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d for d, _ in got], pa.string()), pa.array([w for _, w in got], pa.string())], ["answer_id", "defect", "word"])


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of prompts, names and answers of each task, but for an answer's last word without an end."""
    token = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
    sent: set[str] = set()
    for batch in batches:
        whole: set[str] = set()
        for text, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = token.findall(text.lower())
            if kind == "answer" and text.rstrip()[-1:] not in TERMINAL:
                found = found[:-1]
            whole.update(found)
            if kind == "name":
                whole.update(p for w in found if "-" in w for p in w.split("-"))
        whole -= sent
        sent = sent | whole if len(sent) < 500_000 else whole
        yield pa.RecordBatch.from_arrays([pa.array(list(whole), pa.string())], ["token"])


def _begun(sought: DataFrame, known: DataFrame) -> DataFrame:
    """(token) of the sought ones that are the beginning of a longer known token, whatever their length.

    Up to ``LISTED`` letters the beginnings of the known tokens are listed. In code point order the tokens
    with one beginning follow it directly, so a longer one begins the next known token or none: those are
    sorted with the known tokens of the same first letters, and no list grows with the length of a token.
    """
    starts = F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("token") - 1, F.lit(LISTED))), lambda i: F.left("token", i)))
    short = known.where(F.length("token") > 1).select(starts.alias("token")).join(sought, "token", "left_semi").distinct()
    long = lambda d, is_known: d.where(F.length("token") > LISTED).select(F.left("token", F.lit(LISTED)).alias("head"), "token", F.lit(is_known).alias("known"))
    asked = long(sought, False)
    both = asked.unionByName(long(known, True).join(asked.select("head").distinct(), "head", "left_semi"))
    later = Window.partitionBy("head").orderBy(F.col("token").desc(), "known").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("next", F.last(F.when(F.col("known"), F.col("token")), ignorenulls=True).over(later))
    return short.unionByName(found.where(~F.col("known") & F.startswith("next", "token")).select("token").distinct())


def defective_pairs(answers: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(answer_id, defect) of the defective pairs: empty, truncated, refusal, copies_question or wrong_language.

    ``answers`` has (answer_id, prompt, answer); ``names``, if given, (name) whose words count as whole.
    The first defect of that order holds: empty, copies_question, refusal, wrong_language, truncated.
    Null answers are empty; a null prompt asks nothing and is in no language; rows with a null
    answer_id are left out; rows with the same answer_id, prompt and answer count once. The flag
    ``refused`` is not read. A single sentence without a full stop is cut off if its last word is a
    function word, or no word of any prompt, answer or name but the beginning of one.
    """
    once = answers.where("answer_id is not null").select("answer_id", "prompt", "answer").distinct()
    judged = cut_lineage(once.mapInArrow(_judge, f"answer_id {answers.schema['answer_id'].dataType.simpleString()}, defect string, word string").where("defect is not null or word <> ''"))
    texts = answers.select(F.col("prompt").alias("t"), F.lit("prompt").alias("k")).unionByName(answers.select(F.col("answer").alias("t"), F.lit("answer").alias("k")))
    if names is not None:
        texts = texts.unionByName(names.select(F.col("name").alias("t"), F.lit("name").alias("k")))
    known = cut_lineage(texts.where("t <> ''").mapInArrow(_vocabulary, "token string").distinct())
    asked = judged.where("defect is null").select("answer_id", F.col("word").alias("token"))
    cut = asked.join(known, "token", "left_anti").join(_begun(asked.select("token").distinct(), known), "token", "left_semi")
    sure = judged.where("defect is not null").select("answer_id", "defect")
    return sure.unionByName(cut.select("answer_id", F.lit("truncated").alias("defect"))).distinct()
