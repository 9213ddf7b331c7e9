"""What the text of a record says about itself: its parts, what is residue by its form, and by its words.

A text is cut into what its layout says is the address, title, body and diff of a record. Every
sentence of a part is then judged by itself: residue of some kind, mere frame (trailers, headings)
or content, and only a part without any content is residue; so texts that mention, quote or edit
residue are none. Two things decide. Its form: unfilled variables, instructions in brackets, words
or keys repeated, markup without a record in it. And its words: which of four languages they
belong to, that of records, of pages, of filler or of instructions. What these languages are is
not laid down here but counted in the corpus, in texts that are of a kind by their form (counts()).
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

# --- fixed values: signs and the words of conventions ---------------------------------------

#: How unfilled variables are written around their name.
VARIABLES = (
    r"#\{\s*%s\s*\}", r"\$\{\s*%s\s*\}", r"\{\{\s*%s\s*\}\}", r"\{%%-?\s*%s\s*-?%%\}", r"<%%[=-]?\s*%s\s*-?%%>", r"%%\(%s\)s", r"%%%s%%",
    r"@%s@", r"__%s__", r"\[\[\s*%s\s*\]\]", r"«\s*%s\s*»", r"<%s>", r"\{\s*%s\s*\}",
)
#: Values an empty variable leaves behind.
EMPTY = r"undefined|null|None|NaN|nil|\(none\)|\(null\)|\[object Object\]"
#: Words that surround the variables of a template.
SCAFFOLD = r"release|branch|into|pull|request|tag|bump|from|to|v|chore|feat|fix|docs|test|tests|refactor|perf|style|build|ci|revert|merge|update|reason|task|ticket|refs|what|why|how|reviewed|signed|off|by|closes|see|version|in|for|of|committed|on|commit|author|date|subject|message|patch|diff|index|showing|changed|files"
#: Lines of a message that are kept by tools and say nothing about the change.
TRAILER = re.compile(r"^(?:signed-off-by|reviewed-by|acked-by|tested-by|co-authored-by|reported-by|cc|refs|closes|fixes|see-also|change-id|ticket|issue|bug|link)\b\s*[:#]?\s|^(?:closes|refs|fixes) \S+$|^--$|^---$", re.I)
#: Brackets around an instruction to the author: those that hardly anything else has around a whole line, and others.
STRONG = (r"<<?[^<>]+>>?", r"\[[^\[\]]+\]", r"\{[^{}]+\}", r"_{2,}.+", r"«[^«»]+»")
WEAK = (r"\*[^*]+\*", r"/[^/]+/", r"\([^()]+\)", r"(?:#|\.\.\.) .+", r".+(?:\.\.\.|…)", r"todo\b.+")
#: Reason phrases of the status codes 400 to 511 of HTTP, and what else an answer of a server is known by.
REASONS = (
    "bad request|unauthorized|payment required|forbidden|not found|method not allowed|not acceptable|proxy authentication required|request timeout|conflict|gone|length required|"
    "content too large|range not satisfiable|expectation failed|locked|too many requests|internal server error|not implemented|bad gateway|service unavailable|gateway timeout|"
    "network authentication required|access denied|page not found|error|javascript required|enable javascript|scripts disabled"
)
#: The customary filler text of printers, and names of such text.
LOREM = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor|placeholder text|sample text|dummy text|filler text|text goes here"
#: Customary instructions.
ASKS = "describe the change here|enter a description here|insert a summary here|write a message here|replace this line with a title|your message here|todo explain why"
#: Names of scripts, in several writings.
SCRIPT = re.compile(r"script|\bjs\b|скрипт|スクリプト", re.I)
#: Rows of a keyboard.
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")

# --- the layouts ---------------------------------------------------------------------------

DIFF_START = re.compile(r"^(?:diff --git |Index: \S|--- [ab/]|\+\+\+ [ab/]|@@ -)", re.M)
DIFF_MARK = re.compile(r"^(?:diff --git |Index: \S|@@ -|--- \S|\+\+\+ \S|Binary file|GIT binary|\(binary|index [0-9a-f]+\.\.|[+-])", re.M)
PATH = re.compile(r"^(?:diff --git a/|Index: |\+\+\+ b/)(\S+)", re.M)


@dataclass
class Parts:
    layout: str
    address: str = ""
    title: str = ""
    body: str = ""
    diff: str = ""
    shown: str = field(default="", repr=False)  # what a page shows


def _split(text: str) -> tuple[str, str]:
    m = DIFF_START.search(text)
    return (text[: m.start()], text[m.start() :]) if m else (text, "")


_FIELD = re.compile(r'[\s,]*+"((?:[^"\\]|\\.)*+)"\s*+:\s*+')
_OPEN = re.compile(r'"((?:[^"\\]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+)')


def _export(text: str) -> dict:
    """The fields of a JSON object; of one that is cut off those before the cut and what there is of the last string."""
    try:
        j = json.loads(text)
        return j if isinstance(j, dict) else {}
    except (ValueError, RecursionError):
        pass
    out, at, decoder = {}, 1, json.JSONDecoder(strict=False)
    while m := _FIELD.match(text, at):
        try:
            out[m[1]], at = decoder.raw_decode(text, m.end())
        except (ValueError, RecursionError):
            if s := _OPEN.match(text, m.end()):
                out[m[1]] = decoder.decode(f'"{s[1]}"')
            break
    return out


def _strings(x: object) -> Iterator[str]:
    """The strings and numbers in a JSON value."""
    stack = [x]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            stack += reversed(list(v.values()))
        elif isinstance(v, list):
            stack += reversed(v)
        elif isinstance(v, (str, int)) and not isinstance(v, bool):
            yield str(v)


#: A line that is neither empty nor indented as those of a message.
_OUTSIDE = re.compile(r"^(?!    )(?=.)", re.M)
_TAG = re.compile(r"<[^<>]*>")
_MARKUP = re.compile(r"\s*<[!?a-zA-Z][^<>]*>")
#: Tags that hold a word or a phrase within a sentence.
_INLINE = re.compile(r"</?(?:a|b|i|em|strong|code|span|tt|u|small)\b[^<>]*>", re.I)


def parts_of(text: str) -> Parts:
    """Address, title, body and diff of a text, by its layout; ``page`` for markup and data without a record, ``bare`` where it has none."""
    text = text.replace("\r\n", "\n").strip("\n")
    if text.startswith("{"):
        j = _export(text)
        if "message" in j and ("sha" in j or "patch" in j):
            title, _, body = str(j.get("message") or "").strip().partition("\n")
            return Parts("json", str(j.get("repo") or ""), title.strip(), body.strip(), str(j.get("patch") or "").strip())
        if j and not DIFF_MARK.search(text):
            return Parts("page", shown="\n".join(_strings(j)))
    if _MARKUP.match(text) and ("</" in text or "/>" in text) and not DIFF_START.search(text):
        return Parts("page", shown=_TAG.sub("\n", _INLINE.sub(" ", text)))
    if text.startswith("commit ") and "\nAuthor:" in text.partition("\n\n")[0]:
        _, _, rest = text.partition("\n\n")
        end = m.start() if (m := _OUTSIDE.search(rest)) else len(rest)
        title, _, body = re.sub(r"^ {1,4}", "", rest[:end], flags=re.M).strip().partition("\n")
        diff = rest[end:]
        return Parts("git", "", title.strip(), body.strip(), diff.strip())
    if text.startswith("From ") and "\nSubject:" in text.partition("\n\n")[0]:
        head, _, rest = text.partition("\n\n")
        m = re.search(r"^Subject:(?: \[PATCH[^\]\n]*\])? ?(.*(?:\n[ \t].*)*)", head, re.M)
        message, sep, diff = ("\n" + rest).partition("\n---\n")
        if not sep:
            message, diff = _split(rest)
        return Parts("mail", "", m.group(1).strip() if m else "", message.strip(), diff.strip().removesuffix("--").strip())
    if m := re.match(r"-{20,}\n(r\d+ \|.*|.*\|.*\|.*)\n", text):
        message, diff = _split(text[m.end() :].strip("-\n"))
        title, _, body = message.strip().partition("\n")
        return Parts("svn", "", title.strip(), body.strip(), diff.strip())
    if m := re.match(r"(\S+/\S+ / [0-9a-f]{6,40})\n", text):
        title, _, rest = text[m.end() :].partition("\n")
        rest = rest.partition("\n")[2]
        if s := re.search(r"^Showing \d+ changed files?$", rest, re.M):
            body, diff = rest[: s.start()], rest[s.end() :]
        else:
            body, diff = _split(rest)
        return Parts("web", m.group(1), title.strip(), body.strip(), diff.strip())
    message, diff = _split(text)
    title, _, body = message.strip().partition("\n")
    return Parts("bare", "", title.strip(), body.strip(), diff.strip())


# --- words and sentences ---------------------------------------------------------------------

_WORD = re.compile(r"[^\W\d_]+")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]{2,}")
_DENSE = re.compile(r"[぀-ヿ㐀-鿿]+")
_QUOTE = re.compile(r"""["“”«»‘]|’(?!\w)|(?<!\w)'|'(?!\w)""")


def words_of(s: str) -> set[str]:
    """The words of a sentence in lower case; of writing without spaces every two letters in a row."""
    out = set()
    for w in _WORD.findall(s):
        w = w.lower()
        if _DENSE.search(w):
            out.update(w[i : i + 2] for i in range(max(1, len(w) - 1)))
        else:
            out.add(w)
    return out


def unquoted(s: str) -> str:
    """A line without what stands in quotation marks; an apostrophe is one at the edge of a word only. What is not closed stays."""
    if (t := s.strip()) and len(t) > 1 and t[0] in "\"“«‘'" and t[-1] in "\"”»’'":
        return ""
    out, at, start = [], 0, None
    for q in _QUOTE.finditer(s):
        if start is None:
            if q[0] not in "”»’":
                start = q.start()
        elif q[0] in "\"”»’" or q[0] == "'" and s[q.end() : q.end() + 1].strip(" .,;:!?)") == "":
            out.append(s[at:start])
            at, start = q.end(), None
    return " ".join([*out, s[at:]])


def sentences(line: str) -> list[str]:
    """The sentences of a line, or the items of a row of such."""
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+|(?<=[。！？])|\s+-\s+|\s+\|\s+|\s{2,}|\t", line) if s and s.strip()]


def skeleton(text: str) -> str:
    """A text without numbers, hexadecimal and capitalised names: equal for the same page of other hosts."""
    s = re.sub(r"\b[0-9a-f]{7,64}\b|\d+", "9", text)
    return re.sub(r"\s+", " ", re.sub(r"\b[A-Z]\w*[A-Z]\w*\b", "X", s)).strip().lower()


# --- form ----------------------------------------------------------------------------------

_NAME = r"[^\W\d_][\w.]{0,30}(?: [\w.]{1,20}){0,2}"
_VARIABLE = re.compile("|".join(v % _NAME for v in VARIABLES))
_EMPTY = re.compile(rf"(?<![\w-])(?:v(?=undefined|null|None|NaN|nil|\(|\[object))?(?:{EMPTY})(?!\w)")
_SCAFFOLD = re.compile(rf"(?i)\b(?:{SCAFFOLD})\b")
_MARK = re.compile(r"^(?:#+ |[-*•] )+")
_HEAD = re.compile(r"^(?:what|why|how|reason|task|ticket|refs|summary|description|details|title|subject|reviewed-by|signed-off-by|tested-by)\s*:\s*", re.I)
_STRONG, _WEAK = (re.compile("|".join(f"(?:{w})" for w in ws), re.I) for ws in (STRONG, WEAK))


def unfilled(line: str) -> bool:
    """Nothing but unfilled or emptily filled variables, and the template's own words around them."""
    rest, n = _VARIABLE.subn(" ", line)
    rest, k = _EMPTY.subn(" ", rest)
    if not n + k:
        return False
    rest = re.sub(r"^\s*[\w./-]+(?:\s*\([\w./-]*\))?!?\s*:", " ", rest)  # kind(scope):
    return not _WORD.search(_SCAFFOLD.sub(" ", rest))


_PLACE = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}


def keys_in_a_row(word: str) -> bool:
    """Whether a word is made of runs of three keys or more that lie side by side, in either direction."""
    if _PLACE.get(word[:1], (0,))[0] != _PLACE.get(word[1:2], (9,))[0]:  # as a rule
        return False
    length, step = 1, 0
    for a, b in zip(word, word[1:]):
        (r, i), (q, j) = _PLACE.get(a, (-1, 0)), _PLACE.get(b, (-2, 0))
        d = j - i if r == q and abs(j - i) == 1 else 0
        if d and (length == 1 or d == step):
            length, step = length + 1, d
        elif length < 3:
            return False
        else:
            length, step = 1, 0
    return length >= 3


def degenerate(words: list[str]) -> bool:
    """One word or a few over and over, or keys hit in a row."""
    seen, n = Counter(words), len(words)
    if n >= 3 and len(seen) == 1 or n >= 6 and 3 * len(seen) <= n or n >= 4 and 5 * max(seen.values()) >= 3 * n:
        return True
    return n > 0 and 4 * sum(map(keys_in_a_row, words)) >= 3 * n


#: A word is familiar in at least, and rare in at most, these shares of the records.
FAMILIAR, RARE = 0.004, 0.0005

# --- the languages -------------------------------------------------------------------------

#: The languages that words are counted in: of records, of pages, of filler, of instructions.
RECORD, PAGE, FILLER, ASK = range(4)


def bracketed(line: str) -> str:
    """'strong' or 'weak' if the whole line stands in the brackets of an instruction, else ''."""
    s = _HEAD.sub("", _MARK.sub("", line.strip())).strip()
    if not _WORD.search(s):
        return ""
    return "strong" if _STRONG.fullmatch(s) else "weak" if _WEAK.fullmatch(line.strip()) or _WEAK.fullmatch(s) else ""


_STATUS = re.compile(r"(?:\W*(?:http|error|status)\W*)?\b[45]\d\d\b", re.I)


def furniture(line: str) -> bool:
    """A row of items, as the menu of a page, or a line of its owner."""
    items = [x for x in re.split(r"\s*\|\s*|\s{2,}", line.strip()) if x]
    return len(items) > 2 and all(len(x.split()) <= 4 and _WORD.match(x) for x in items) or bool(re.match(r"(?:\(c\)|©)\s*\S", line.strip(), re.I))


def message_words(p: Parts) -> set[str]:
    """The Latin words of title and body, without trailers."""
    return {w.lower() for x in [p.title, *p.body.split("\n")] if not TRAILER.match(x.strip()) for w in _LATIN.findall(x)}


def counts(p: Parts) -> list[tuple[int, set[str]]]:
    """(language, words) of the parts of a text whose form tells their language."""
    if p.layout == "page":
        return [(PAGE, words_of(p.shown))]
    out: list[tuple[int, set[str]]] = []
    real = bool(DIFF_MARK.search(p.diff))
    if p.diff.strip() and not real:  # stands where a diff should
        out.append((PAGE, words_of(_TAG.sub(" ", p.diff))))
    lines = [x.strip() for x in [p.title, *p.body.split("\n")] if x.strip() and not TRAILER.match(x.strip())]
    if p.layout == "bare" and not real and lines and (_STATUS.match(lines[0]) or any(furniture(x) for x in lines)):
        return [(PAGE, words_of(" ".join(lines)))]
    if not lines or p.layout == "bare" and not real:  # a message or a page
        return out
    kinds = [form(x) or bracketed(x) for x in lines]
    if kinds[0] == "filler":
        out.append((FILLER, words_of(" ".join(lines))))
    elif kinds[0] in ("ask", "unfilled", "weak"):
        if asked := " ".join(x for x, k in zip(lines, kinds) if k != "unfilled"):
            out.append((ASK, words_of(asked)))
    elif not {"ask", "unfilled", "filler"} & set(kinds):
        out.append((RECORD, words_of(unquoted("\n".join(lines)))))
    return out


def form(line: str) -> str:
    """'unfilled', 'ask', 'filler', 'frame' or '' by the form of a line alone."""
    s = line.strip()
    bare = _HEAD.sub("", _MARK.sub("", s)).strip()
    if unfilled(s) or bare and unfilled(bare):
        return "unfilled"
    if bracketed(s) == "strong":
        return "ask"
    if not s or TRAILER.match(s) or not _WORD.search(s):
        return "frame"
    said = ([w.strip(".,;:!?()").lower() for w in x.split() if _WORD.search(w)] for x in sentences(s))
    return "filler" if all(degenerate(w) for w in said if w) else ""  # as a rule the first sentence decides


class Tally(dict):
    """Word to [records, texts of each language] of the texts added; the word null has the numbers of all."""

    def __missing__(self, word: str | None) -> list[int]:
        self[word] = row = [0] * 5
        return row

    def add(self, p: Parts) -> None:
        """Takes in the parts of one text. Words of texts that are or may be pages are in no record."""
        found = counts(p)
        self[None][0] += 1
        for k, words in found:
            self[None][1 + k] += 1
            for w in words:
                self[w][1 + k] += 1
        if p.layout != "page" and (p.layout != "bare" or DIFF_MARK.search(p.diff)):
            for w in message_words(p):
                self[w][0] += 1


#: Weight of the whole corpus in a word's shares, sightings at which half a word's weight counts, most that a word can weigh.
PRIOR, TRUST, MOST = 2.0, 2.0, 4.0
#: Texts of records that are taken to be known of any corpus, and texts of a language at which half the weight of an absence counts.
KNOWN, FEW = 100, 5


def telling(row: Sequence[int], all_: Sequence[int]) -> bool:
    """Whether a word is kept: in more than RARE of the records and in three, or in more than RARE of the texts of a language but that of records. So at most the words of a text / RARE are."""
    return row[0] > max(2, RARE * all_[0]) or any(row[k] > RARE * all_[k] for k in (2, 3, 4))


class Model:
    """What words weigh for each language against that of records, and in how many records they are.

    ``table`` gives each word its records and the numbers of texts of the four languages it is in,
    and the word null the numbers of all: a Tally, or the rows of one that telling() keeps.
    """

    def __init__(self, table: Mapping[str | None, Sequence[int]]):
        records, *totals = table.get(None, (0,) * 5)
        table = {w: c for w, c in table.items() if w is not None and telling(c, (records, *totals))}
        self.records = records
        self.df = {w: c[0] for w, c in table.items()}
        known = {RECORD: "", PAGE: REASONS, FILLER: LOREM, ASK: ASKS}
        self.weights: list[dict[str, float]] = [{} for _ in known]
        for k, phrases in known.items():
            if k == RECORD:
                continue
            prior = dict.fromkeys(words_of(phrases), 1)  # as if each word had been seen once
            n_k, n_r = totals[k] + len(phrases.split("|")), totals[RECORD] + KNOWN
            for w in table.keys() | prior.keys():
                c = table.get(w, (0,) * 5)
                a, b = c[1 + k] + prior.get(w, 0), c[1 + RECORD]
                if not a + b:
                    continue
                p0 = (a + b) / (n_k + n_r)
                odds = math.log((a + PRIOR * p0) / (n_k + PRIOR)) - math.log((b + PRIOR * p0) / (n_r + PRIOR))
                odds = max(-MOST, min(MOST, odds)) * (a + b) / (a + b + TRUST)
                # that a word is not in a language tells the more the more texts of it are known
                self.weights[k][w] = odds if odds > 0 else odds * totals[k] / (totals[k] + FEW)

    def weigh(self, words: Iterable[str], language: int) -> float:
        w = self.weights[language]
        return sum(w.get(x, 0.0) for x in words)


# --- verdicts --------------------------------------------------------------------------------

#: Weight from which on words tell a language, and below which (negative) a sentence is content. Twice as much is
#: asked of a last paragraph that may stand in a diff's place.
SURE = 2.0
#: Words a message has at least to be called filler by its words alone, and shares of unfamiliar and rare ones.
WORDS, UNFAMILIAR_SHARE, RARE_SHARE, TITLE_SHARE = 4, 0.7, 0.3, 0.5
#: Unfamiliar words in the first line of a text that may be a page because several hosts serve it.
STRANGE = 2
#: Records from which on it is known which words are rare.
RECORDS = 500


@dataclass
class Verdict:
    """``kind`` '' if the text alone decides nothing; ``score`` then is what its words weigh for a page, null if it cannot be one."""

    kind: str = ""
    place: str = ""
    score: float | None = None


def judge(line: str, m: Model) -> str:
    """'unfilled', 'ask', 'filler', 'frame' or 'content': by its form, and by its words without what they quote."""
    if k := form(line):
        return k
    own = [words_of(x) for x in sentences(unquoted(line))]
    own = [w for w in own if w]
    weak = bracketed(line) == "weak"
    if own and (weak or len(own) == 1) and all(m.weigh(w, ASK) > (0 if weak else SURE) for w in own):
        return "ask"
    if own and all(m.weigh(w, FILLER) > SURE or degenerate(sorted(w)) for w in own):
        return "filler"
    return "content"


def message_kind(title: str, body: str, m: Model) -> str:
    """The kind of residue that stands in place of a message, or ''.

    A message is residue if none of its lines is content, or if its title, which should say what
    changed, is unfilled.
    """
    first = judge(title, m) if title.strip() else "frame"
    if first == "content" and len(words := [w.lower() for w in _WORD.findall(title)]) > 1 and len(set(words)) == 1:
        first = "filler"
    if first in ("content", "unfilled"):
        return "" if first == "content" else first
    said = words_of(title) if first == "filler" else set()
    kinds = [] if first == "frame" else [first]
    for line in body.split("\n"):
        k = judge(line, m)
        if k == "filler":
            said |= words_of(line)
        if k == "content" and not words_of(line) <= said:
            return ""
        if k not in ("frame", "content"):
            kinds.append(k)
    return kinds[0] if kinds else ""


def page_score(shown: str, related: set[str], m: Model) -> float | None:
    """What the words weigh for a page; null if a sentence is content or nothing is said. ``related`` are words of the address and the paths."""
    seen: set[str] = set()
    for line in shown.split("\n"):
        if TRAILER.match(line.strip()):
            return None
        own = unquoted(line)
        if words_of(line) and not words_of(own):
            return None  # a quotation and nothing else
        for s in sentences(own):
            words = words_of(s)
            if m.weigh(words, PAGE) - MOST * len(words & related) / 2 < -SURE:
                return None
            seen |= words
    return m.weigh(seen, PAGE) - MOST * len(seen & related) / 2 if seen else None


def page_kind(shown: str) -> str:
    return "script" if SCRIPT.search(shown) else "error"


def salad(p: Parts, related: set[str], m: Model) -> bool:
    """A message of words that hardly any other record uses, none of which is of the address or the paths."""
    title, words = {w.lower() for w in _LATIN.findall(p.title)}, message_words(p)
    if m.records < RECORDS or len(words) < WORDS or words & related:
        return False
    strange = {w for w in words if m.df.get(w, 0) < FAMILIAR * m.records}
    rare = sum(m.df.get(w, 0) <= max(2, RARE * m.records) for w in strange)
    return len(strange) >= UNFAMILIAR_SHARE * len(words) and rare >= RARE_SHARE * len(words) and len(strange & title) >= TITLE_SHARE * len(title)


def related_words(p: Parts, host: str | None) -> set[str]:
    """The words of the address, the host and the changed paths."""
    return {w.lower() for w in _LATIN.findall(" ".join([p.address.split(" / ")[0], host or "", *PATH.findall(p.diff)]))}


def examine(p: Parts, host: str | None, m: Model) -> Verdict:
    """What is known of a text from itself and the languages of the corpus."""
    real, related = bool(DIFF_MARK.search(p.diff)), related_words(p, host)
    if p.layout == "page":
        score = page_score(p.shown, related, m)
        return Verdict(page_kind(p.shown), "text") if score is not None and score > SURE else Verdict(score=score)
    if kind := message_kind(p.title, p.body, m):
        return Verdict(kind, "message" if p.layout != "bare" or p.diff else "text")
    if p.diff.strip() and not real:
        shown = parts_of(p.diff).shown or p.diff
        if kind := message_kind("", p.diff, m):
            return Verdict(kind, "diff")
        score = page_score(shown, related, m)
        if score is not None and score > SURE:
            return Verdict(page_kind(shown), "diff")
    score = None
    if p.layout == "bare" and not p.diff:
        shown = f"{p.title}\n{p.body}"
        score = page_score(shown, related, m)
        if score is not None and score > SURE:
            return Verdict(page_kind(shown), "text")
        # where no word speaks for a page hosts decide, but not on words that every record uses
        if score is not None and score <= 0 and (m.records < RECORDS or sum(m.df.get(w, 0) < FAMILIAR * m.records for w in {w.lower() for w in _LATIN.findall(p.title)}) < STRANGE):
            score = None
    if p.layout in ("svn", "bare") and not p.diff and p.body:
        # no diff follows: the last paragraphs may stand in its place
        paragraphs = [x for x in p.body.split("\n\n") if x.strip()]
        for n in (1, 2, 3):
            last = "\n\n".join(paragraphs[-n:])
            shown = parts_of(last).shown or last
            own = page_score(shown, related, m)
            if own is not None and own > 2 * SURE:
                return Verdict(page_kind(shown), "diff")
            if n == 1 and (k := message_kind("", last, m)) in ("unfilled", "ask"):
                return Verdict(k, "diff")
    if salad(p, related, m):
        return Verdict("filler", "text" if p.layout == "bare" and not p.diff else "message", score)
    return Verdict(score=score)
