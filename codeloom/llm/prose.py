"""Statistics of texts, and which texts are natural prose.

A text is taken apart into units: sentences of running lines (wrapped lines are joined, markup such as comment marks
and bullets is set aside), and single lines where a line is no running text. Thresholds on a unit's statistics are
labelling functions: each says prose, not prose, or nothing, and each errs. How often each errs is not set but learned,
by expectation-maximization over how they agree and disagree on all units of the corpus. The posterior of a unit's votes
says whether it is a running sentence; a text is prose if such sentences make up half of its characters or more.

Texts repeat their words, so what a function needs to know of a word is worked out once per word and process; the
figures of units, lines and texts are then sums over word numbers in arrays, for very many texts at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import Scratch

#: Share of a text's characters in running sentences from which it is prose.
PROSE_SHARE = 0.5
#: A text of at least so many units is mere repetition if distinct ones make up no more than this share of them.
REPEAT_UNITS, REPEAT_SHARE = 4, 0.2
#: So is a text of more units than that of which one is at least this share.
REPEAT_TOP = 0.6

#: A unit of at least so many words repeats itself if distinct ones make up no more than this share of them.
LOOP_WORDS, LOOP_SHARE = 12, 0.15
#: A line of more words than that without any punctuation is a unit of its own, and seems to run on.
RUN_ON = 36
#: A unit of LOOP_WORDS words or more seems to be word salad if common words make up more than SALAD + SPREAD / sqrt(words)
#: of it, and to have too few of them for a language that has common words if they make up less than BARE.
SALAD, SPREAD, BARE = 0.58, 0.35, 0.08
#: Such a unit seems to have no order of words if an article stands before an article or a frequent verb so often.
CLASH_EVERY = 150

#: The labelling functions. The first ones are thresholds on what every unit has; ``SPECIFIC`` ones know one kind of junk
#: or list and abstain from all else.
GENERAL = ("length", "plain", "common", "symbols", "digits", "verb", "separators", "ending", "list")
SPECIFIC = ("log", "entry", "comment", "run_on", "loop", "salad", "order", "bare")
NAMES = GENERAL + SPECIFIC
#: What the learning assumes before it has seen a unit: how often a general function is right when it votes, and how
#: seldom a specific one says no to prose.
RIGHT, SELDOM = 0.6, 0.01

#: Characters of texts that are worked on at once, and words that a process remembers.
AT_ONCE, REMEMBERED = 2_000_000, 1_000_000
#: Words that a list of common words may have.
MOST_COMMON = 100_000

_BREAK = re.compile("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_MARK = re.compile(r"(?:(?://+[!/]*|/\*+!?|\*+/|\*|#+|>+|--+|%+|<!--|-->|\"\"\")\s*)*")
_BULLET = re.compile(r"(?:[-*+•·‣–]|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,5})[.)]|\[[ xX]?\])\s+")
_PLAIN = re.compile(r"[(\[\"'“‘«¿¡*_]*[^\W\d_]+(?:['’‐-][^\W\d_]+)*[)\]\"'”’»*_]*[.,;:!?…]*[)\]\"'”’»*_]*\Z")
_CAMEL = re.compile(r"[a-zß-ÿ][A-ZÀ-Þ]|[A-Z]{2}[a-z]{2}")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CJK = re.compile("[぀-ヿ㐀-鿿]")
_KANA = re.compile("[ぁ-ゟ]")
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()\-…。、「」¿¡“”‘’«»–—/]|_")
_SEPARATOR = re.compile(r"\||;(?=\S)|,(?=[^\s\d\"'”’»)])|\.{4,}|</?\w+")
_GAP = re.compile(r"(?<=\S)(?:\t+| {3,})")
_NAME = re.compile(r"[A-Za-z]\w*(?:\(\))?[.,;:!?]*\Z")
_LEAD = re.compile(r"[\"'“(]?[A-Z][a-z]+ed\Z")
_STOP = re.compile(r"[.,;:!?…]")
_DIGIT = re.compile(r"\d")
_CODE = re.compile(r"#(?:include|pragma|define|if|endif)|\w+\(\)\s*\Z")
_LOG = re.compile(r"(?:[<\[(]?\d+[>\])]\s*)?[\[(]?(?:\d{1,4}[-./]\d{1,2}[-./]\d{1,4}[-T ]?)?\d{1,2}[:.]\d\d[:.]\d\d|(?:at|File) \S+[:(]+\S*\d|[0-9a-fA-F]{6,}\s")
_SENTENCE_END = re.compile(r"[.!?…][\"'”’»)\]*_]*\Z|[。！？]\Z")
_CJK_STOP = re.compile(r"(?<=[。！？])(?=[^\s\"'”’»)\]*_])")
_CLOSERS = "\"'”’»)]*_"

# Finite verbs that are frequent in the four languages, and words that begin a noun phrase in them, and those
# of the latter that stand neither before a finite verb nor before each other.
_AUXILIARIES = frozenset(
    "is are was were be been has have had does do did can could will would shall should may might must am isn't don't doesn't "
    "it's that's can't won't we'll they're i've we've let's needs seems makes takes goes gets lets let says said see saw went "
    "ist sind war waren wird werden wurde wurden hat haben hatte kann können muss müssen soll sollte darf will bleibt steht gibt "
    "es son era eran fue fueron está están ha han había hay puede pueden debe deben tiene tienen hace hacen dice queda".split()
)
_DETERMINERS = frozenset(
    "the a an its his her their our your my this that these those every each all any some no two three nothing for it them us "
    "der die das den dem des ein eine einen einem einer zwei drei alle jede jeden jedes kein keine nichts mein sein ihr ihre diese dieser "
    "el la los las un una unos unas dos tres todo todos toda todas cada su sus este esta estos nada".split()
)
_ARTICLES = frozenset("the a an its their our your my dem des einen einem einer el los las un una unos unas su sus".split())
_VERB_END = re.compile(r"(?:[^s]s|ed|[^\W\d_]t|[aeé]n?)\Z")
_JAPANESE_VERB = re.compile("(?:る|た|い|す|う|く|ん|ます|です|だ)[。！？」]?\\Z")

#: Stands for a tab or a wide gap within a line; no text has it as a word of its own.
_WIDE = "\x02"
FIGURES = (
    "size", "n", "plain", "symbols", "digits", "separators", "cjk", "kana", "words", "letters", "common", "auxiliary",
    "determiner", "verbal", "ends", "terminal", "question", "stop", "lead", "japanese_verb",
    "article", "form",
)


class Lexicon(dict):
    """The number of each word seen, and per number the word's figures: in ``column[name]``, after ``settle``."""

    def __init__(self, common: Iterable[str]):
        super().__init__()
        self.common = frozenset(common)
        self.fresh: list[tuple] = []
        self.column = {name: np.zeros(0, dtype=np.int64) for name in FIGURES}

    def __missing__(self, word: str) -> int:
        self.fresh.append(self._figures(word))
        self[word] = number = len(self)
        return number

    def _figures(self, word: str) -> tuple:
        if word == _WIDE:
            return (0, 0, 0, 0, 0, 1, *[0] * (len(FIGURES) - 6))
        bare = word.lower().replace("’", "'")
        words = _WORD.findall(bare)
        is_plain = bool(_PLAIN.match(word)) and not _CAMEL.search(word)
        form = re.sub(r"\W+", "", bare)
        return (
            len(word),
            1,
            int(is_plain or bool(_NAME.match(word))),
            len(_SYMBOL.findall(word)),
            len(_DIGIT.findall(word)),
            1 if word == "/" else len(_SEPARATOR.findall(word)),
            len(_CJK.findall(word)),
            len(_KANA.findall(word)),
            len(words),
            sum(map(len, words)),
            sum(map(self.common.__contains__, words)),
            int(not _AUXILIARIES.isdisjoint(words)),
            int(bare in _DETERMINERS),
            int(len(word) > 3 and bare not in self.common and word.isalpha() and bool(_VERB_END.search(bare))),
            int(bool(_SENTENCE_END.search(word))),
            int(word.rstrip(_CLOSERS)[-1:] in tuple(".!?…。！？")),
            int(word.endswith(("?", "？"))),
            int(bool(_STOP.search(word))),
            int(bool(_LEAD.match(word))),
            int(bool(_JAPANESE_VERB.search(word))),
            int(bare in _ARTICLES),
            xxhash.xxh64_intdigest(form) >> 1 if form else 0,
        )

    def settle(self) -> None:
        """Brings the figures of new words into the columns."""
        if self.fresh:
            for name, values in zip(FIGURES, zip(*self.fresh)):
                self.column[name] = np.concatenate([self.column[name], np.array(values, dtype=np.int64)])
            self.fresh = []


def _read(texts: list[str], lexicon: Lexicon) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The words of all lines, one after the other, as numbers, and per line that is not blank: its text, number of
    words, where it stands and how it looks."""
    words: list[int] = []
    number = lexicon.__getitem__
    rows: list[tuple] = []
    for at, text in enumerate(texts):
        if not text.isascii():
            text = _CJK_STOP.sub(" ", text.lstrip("\ufeff"))
        gap, mark_before = 1, None
        for raw in _BREAK.split(text):
            line = raw.lstrip()
            if not line:
                gap = 1
                continue
            mark = ""
            if line[0] in "/*#>-%<\"" and (mark := _MARK.match(line).group()):
                line = line[len(mark) :]
            bullet = _BULLET.match(line)
            lead = mark.strip()
            changed = lead != mark_before
            if bullet:
                line, lead = line[bullet.end() :], lead + bullet.group().strip()
            if "\t" in line or "   " in line:
                line = _GAP.sub(f" {_WIDE} ", line.strip())
            parts = line.split()
            if not parts:  # markup only: counts in the text's figures, and ends a block
                rows.append((at, 0, number(lead) if lead else -1, 1, 0, 0, 0, 0))
                gap = 1
                continue
            words.extend(map(number, parts))
            log = _LOG.match(line) is not None
            code = raw.rstrip()[-1:] in (";", "{", "}") or _CODE.match(raw.lstrip()) is not None
            rows.append((at, len(parts), number(lead) if lead else -1, int(gap or changed or bullet is not None), int(bullet is not None), int(bool(mark.strip())), int(log), int(code)))
            gap, mark_before = 0, mark.strip()
    lexicon.settle()
    names = ("text", "n", "lead", "starts", "bullet", "marked", "log", "code")
    table = np.array(rows, dtype=np.int64).reshape(-1, len(names))
    return np.array(words, dtype=np.int64), {name: table[:, i] for i, name in enumerate(names)}


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sums of the stretches that begin at ``starts`` (ascending, the first 0, none empty)."""
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, dtype=values.dtype)


def _latest(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """For each place the value at the last place up to it that is known; 0 before the first."""
    at = np.maximum.accumulate(np.where(known, np.arange(len(values)), -1))
    return np.where(at >= 0, values[np.maximum(at, 0)], 0)


def _units(words: np.ndarray, lines: dict[str, np.ndarray], lexicon: Lexicon) -> dict[str, np.ndarray]:
    """The units of all texts: ``start`` (first word), ``text``, ``entry`` (of a list), ``comment`` (among code), ``heap``."""
    figure = lexicon.column
    full = lines["n"] > 0
    line = {k: v[full] for k, v in lines.items()}
    n = line["n"]
    start = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64) if len(n) else np.zeros(0, dtype=np.int64)
    total = lambda name: _sums(figure[name][words], start)
    count, cjk = total("n"), total("cjk")
    is_cjk = cjk * 3 >= total("size") + n - 1
    heap = (total("stop") == 0) & (count > RUN_ON) & (cjk == 0)
    looks = is_cjk | ((total("plain") >= 0.6 * count) & (total("separators") <= 0.05 * count))
    running = looks & (line["log"] == 0) & ~heap
    new_text = np.ones(len(n), dtype=bool)
    new_text[1:] = line["text"][1:] != line["text"][:-1]
    after_other = np.ones(len(n), dtype=bool)
    after_other[1:] = ~running[:-1]
    # A line of markup only ends the block before it, as a blank line does: it is told by the line after it.
    first = new_text | (line["starts"] > 0) | after_other | ~running
    # Whether code came last before a comment: other lines say yes or no, unmarked running lines say no.
    says = ~running & ~heap | running & (line["marked"] == 0)
    code = np.where(running, 0, line["code"])
    before = np.zeros(len(n), dtype=np.int64)
    if len(n):
        so_far = _latest(code, says | new_text)
        so_far = np.where(new_text & ~says, 0, so_far)
        before[1:] = so_far[:-1]
        before[new_text] = 0
    comment = running & (before > 0) & (line["marked"] > 0) & (line["bullet"] == 0)
    # Words: a unit begins with a block's first line and after each sentence end within running lines.
    of_line = np.repeat(np.arange(len(n)), n)
    begins = np.zeros(len(words), dtype=bool)
    begins[start[first]] = True
    ends = (figure["ends"][words] > 0) & running[of_line]
    begins[1:] |= ends[:-1]
    at = np.flatnonzero(begins)
    # What a block's first line is holds for all of its units.
    block = np.maximum.accumulate(np.where(first, np.arange(len(n)), 0))[of_line[at]] if len(at) else at
    return {"start": at, "text": line["text"][of_line[at]], "entry": line["bullet"][block] > 0, "comment": comment[block], "heap": heap[block], "log": line["log"][of_line[at]] > 0}


def _thresholds(value: np.ndarray, yes: np.ndarray, no: np.ndarray) -> np.ndarray:
    return np.where(yes, 1, np.where(no, 0, 2))


def _vote(words: np.ndarray, unit: dict[str, np.ndarray], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each unit: its votes as a number to the base 3, its characters, words and common words."""
    start, figure = unit["start"], lexicon.column
    total = lambda name: _sums(figure[name][words], start)
    length = np.diff(np.append(start, len(words)))
    of_unit = np.repeat(np.arange(len(start)), length)
    last = words[start + length - 1] if len(start) else words[:0]
    size = np.maximum(total("size"), 1)
    cjk, kana = total("cjk") / size, total("kana") / size
    is_cjk = cjk >= 0.3
    tokens = np.maximum(total("n"), 1)
    n = np.where(is_cjk, np.maximum(1, np.round(cjk * size / 2)), tokens)
    common = np.where(is_cjk, np.round(kana * n), total("common"))
    share = np.where(is_cjk, kana, common / n)
    plain = np.where(is_cjk, cjk, total("plain") / tokens)
    # A verb: a frequent one, a question, a participle that leads, or a verb's ending before the beginning of a noun phrase.
    pair = np.zeros(len(words), dtype=bool)
    pair[:-1] = (figure["verbal"][words[:-1]] > 0) & (figure["determiner"][words[1:]] > 0) & (of_unit[:-1] == of_unit[1:])
    clash = np.zeros(len(words), dtype=np.int64)
    clash[:-1] = (figure["article"][words[:-1]] > 0) & (figure["article"][words[1:]] + figure["auxiliary"][words[1:]] > 0) & (of_unit[:-1] == of_unit[1:])
    clash = _sums(clash, start)
    verb = (total("auxiliary") > 0) | ((figure["question"][last] > 0) & (total("words") > 3)) | (_sums(pair.astype(np.int64), start) > 0)
    verb |= (figure["lead"][words[start]] > 0) & (length > 1)
    verb = np.where(is_cjk, (figure["japanese_verb"][last] > 0) & (kana >= 0.15), verb)
    # Distinct words of a unit.
    form = figure["form"][words]
    counted = form > 0
    pairs = np.stack([of_unit[counted], form[counted]])
    order = np.lexsort(pairs[::-1])
    pairs = pairs[:, order]
    fresh = np.ones(pairs.shape[1], dtype=bool)
    fresh[1:] = (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)
    distinct = np.bincount(pairs[0][fresh], minlength=len(start))
    many, flat = tokens >= LOOP_WORDS, ~is_cjk
    symbols, digits, separators = total("symbols") / size, total("digits") / size, total("separators") / n
    # Of the other entries of a text's lists: how many there are, and how many of them have a verb.
    entry = unit["entry"]
    others, verbs = (np.bincount(unit["text"], weights=w, minlength=1)[unit["text"]] - w for w in (entry.astype(float), entry * verb.astype(float)))
    listed = entry & (others >= 2)
    no = lambda fires: np.where(fires, 0, 2)
    votes = (
        _thresholds(n, n >= 7, n <= 4),
        _thresholds(plain, plain >= 0.8, plain < 0.65),
        _thresholds(share, share >= 0.3, share < 0.17),
        _thresholds(symbols, symbols <= 0.02, symbols > 0.06),
        _thresholds(digits, digits <= 0.04, digits > 0.12),
        np.where(entry, 2, verb),
        _thresholds(separators, separators == 0, separators > 0.06),
        np.where(figure["terminal"][last] > 0, 1, 2),
        _thresholds(others, listed & (verbs >= 0.7 * others), listed & (verbs <= 0.4 * others)),
        no(unit["log"]),
        no(entry & ~verb.astype(bool)),
        no(unit["comment"]),
        no(unit["heap"]),
        no(flat & many & (distinct <= LOOP_SHARE * tokens)),
        no(flat & many & (share > SALAD + SPREAD / np.sqrt(tokens))),
        no(many & (CLASH_EVERY * clash >= tokens)),
        no(flat & many & (share < BARE)) if lexicon.common else np.full(len(start), 2),
    )
    code = np.zeros(len(start), dtype=np.int64)
    for v in votes:
        code = 3 * code + v
    return code, total("size"), n.astype(np.int64), common.astype(np.int64)


def _repeated(words: np.ndarray, start: np.ndarray, text: np.ndarray, count: int, lexicon: Lexicon) -> np.ndarray:
    """For each of ``count`` texts whether few of its parts are distinct; they begin at ``start``, in the texts ``text``.
    Punctuation and letter case make no difference."""
    if not len(start):
        return np.zeros(count, dtype=bool)
    place = np.arange(len(words)) - np.repeat(start, np.diff(np.append(start, len(words))))
    power = np.multiply.accumulate(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
    form = _sums(lexicon.column["form"][words].astype(np.uint64) * power[place], start)
    form ^= (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    _, index, often = np.unique(form, return_index=True, return_counts=True)
    at, parts = text[index], np.bincount(text, minlength=count)
    distinct, most = np.bincount(at, minlength=count), np.zeros(count, dtype=np.int64)
    np.maximum.at(most, at, often)
    return (parts >= REPEAT_UNITS) & (distinct <= np.maximum(1, REPEAT_SHARE * parts)) | (parts > REPEAT_UNITS) & (most >= REPEAT_TOP * parts)


def describe(texts: list[str], lexicon: Lexicon) -> pa.RecordBatch:
    """The statistics of texts and the votes on their units, as in ``FIELDS`` without the id."""
    words, lines = _read(texts, lexicon)
    figure = lexicon.column
    count = len(texts)
    unit = _units(words, lines, lexicon)
    per_text = lambda at, values: np.bincount(at, weights=values, minlength=count)
    of_word = np.repeat(lines["text"], lines["n"])
    led = lines["lead"] >= 0
    lead, lead_at = lines["lead"][led], lines["text"][led]
    total = lambda name: per_text(of_word, figure[name][words]) + per_text(lead_at, figure[name][lead])
    solid, n_letters, n_bare, n_symbols = (total(name) for name in ("size", "letters", "words", "symbols"))
    full = lines["n"] > 0
    last = words[np.cumsum(lines["n"][full]) - 1] if len(words) else words
    ended = per_text(lines["text"][full], figure["terminal"][last])
    n_lines = np.bincount(lines["text"], minlength=count)
    code, size, n, n_common = _vote(words, unit, lexicon)
    n_words, n_common = per_text(unit["text"], n), per_text(unit["text"], n_common)
    line_start = np.cumsum(lines["n"][full]) - lines["n"][full]
    repeated = _repeated(words, unit["start"], unit["text"], count, lexicon) | _repeated(words, line_start, lines["text"][full], count, lexicon)
    # The characters of each pattern of votes in a text. The rest (marks, bullets) counts for no pattern.
    every = 3 ** len(NAMES)
    both, where = np.unique(unit["text"] * every + code, return_inverse=True)
    keys = both // every, both % every
    chars = np.bincount(where, weights=size, minlength=len(both)).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(keys[0], minlength=count))])
    votes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(keys[1]), pa.array(chars)], names=["code", "chars"]))
    share = lambda a, b: pa.array(np.divide(a, b, out=np.zeros(count), where=b > 0))
    columns = [pa.array(solid.astype(np.int64)), pa.array(n_words.astype(np.int64)), share(n_letters, n_bare), share(n_symbols, solid), share(ended, n_lines), share(n_common, n_words), pa.array(repeated), votes]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in FIELDS.split(", ")[1:]])


FIELDS = "doc_id long, n_chars long, n_words long, mean_word_length double, symbol_share double, ending_share double, common_share double, repeated boolean, votes array<struct<code:long,chars:long>>"


def _describer(common: frozenset):
    def run(batches: Iterable[pa.RecordBatch]):
        lexicon = Lexicon(common)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            begin = 0
            while begin < batch.num_rows:
                size, end, group = 0, begin, []
                while end < batch.num_rows and size < AT_ONCE:
                    text = texts[end].as_py() or ""
                    group.append(text)
                    size, end = size + len(text), end + 1
                if len(lexicon) > REMEMBERED:
                    lexicon = Lexicon(common)
                found = describe(group, lexicon)
                yield pa.RecordBatch.from_arrays([ids.slice(begin, end - begin), *found.columns], names=["doc_id", *found.schema.names])
                begin = end

    return run


def unpacked(codes: list[int]) -> np.ndarray:
    """The votes of each pattern: pattern by function."""
    return np.array([[c // 3 ** (len(NAMES) - 1 - k) % 3 for k in range(len(NAMES))] for c in codes])


def learn(counts: dict[int, float], rounds: int = 100, without: Iterable[str] = ()) -> dict[int, float]:
    """The posterior probability of prose for each pattern of votes, given how often each came.

    The model: a unit is prose or not, and given that, each labelling function votes by itself, with its own
    probability of each vote. Expectation-maximization begins from ``RIGHT`` and ``SELDOM``; from then on the corpus alone
    says how much each vote weighs. Functions in ``without`` are left out.
    """
    codes = sorted(counts)
    if not codes:
        return {}
    weight = np.array([counts[c] for c in codes], dtype=float)
    votes = unpacked(codes)
    used = np.array([name not in without for name in NAMES])
    specific = np.array([name in SPECIFIC for name in NAMES])
    one_hot = np.stack([votes == v for v in (0, 1, 2)], axis=-1).astype(float)  # pattern, function, vote
    one_hot[:, ~used] = 0
    sure = np.log(RIGHT / (1 - RIGHT))
    odds = np.where(votes == 1, sure, np.where(votes == 0, np.where(specific, np.log(SELDOM), -sure), 0))[:, used].sum(axis=1)
    post = 1 / (1 + np.exp(-odds))
    for _ in range(rounds):
        table = []
        for p in (1 - post, post):
            t = np.einsum("p,pfv->fv", weight * p, one_hot) + 1.0
            table.append(np.log(t / t.sum(axis=1, keepdims=True)))
        prior = np.log((weight * post).sum() + 1) - np.log((weight * (1 - post)).sum() + 1)
        score = prior + np.einsum("pfv,fv->p", one_hot, table[1] - table[0])
        new = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return dict(zip(codes, post.tolist()))


def text_types(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """One row per row of ``documents``: ``doc_id``, the statistics, ``prose_share`` and ``text_type``.

    ``text_type``: ``empty`` (null, empty or only white space), ``repetition`` (one line or sentence over and over),
    ``prose``, or ``other``. ``common_words`` is a small fixed table of at most ``MOST_COMMON`` words, more are an error;
    letter case there does not matter, and without it no function says anything of common words. Whole texts are read.
    How often each pattern of votes comes is counted over all documents; only these counts reach the driver (patterns
    grow with about the fourth root of the texts: about 210, 330 and 560 for 1,000, 10,000 and 100,000 of them). An empty table
    gives no rows; repeated rows and null ids come out each.
    """
    scratch = Scratch(documents.sparkSession, "prose")
    common = frozenset(r[0] for r in common_words.select(F.lower("word")).dropna().distinct().limit(MOST_COMMON + 1).collect())
    if len(common) > MOST_COMMON:
        raise ValueError(f"more than {MOST_COMMON} common words")
    picked = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = scratch.save(picked.mapInArrow(_describer(common), FIELDS))
    patterns = described.select(F.explode("votes").alias("v")).groupBy("v.code").agg(F.sum("v.chars").alias("chars")).collect()
    posterior = learn({r["code"]: float(r["chars"]) for r in patterns})
    good = [code for code, p in sorted(posterior.items()) if p >= 0.5]
    inside = F.aggregate("votes", F.lit(0).cast("long"), lambda a, v: a + F.when(v["code"].isin(good), v["chars"]).otherwise(0))
    share = F.when(F.col("n_chars") > 0, inside / F.col("n_chars")).otherwise(0.0)
    kind = F.when(F.col("n_chars") == 0, "empty").when(F.col("repeated"), "repetition").when(F.col("prose_share") >= PROSE_SHARE, "prose").otherwise("other")
    return described.withColumn("prose_share", share).withColumn("text_type", kind).drop("votes", "repeated")


def statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    return text_types(documents, common_words)


def not_prose(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """The ids (``doc_id``) of the documents with a text that is not natural prose."""
    return text_types(documents, common_words).where("text_type in ('other', 'repetition')").select("doc_id")
