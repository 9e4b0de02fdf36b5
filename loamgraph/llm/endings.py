"""How a text ends: its last words as keys, and what the corpus says about them."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Words of context kept of an ending.
ORDER = 3

_LINE_START = r"(?=\Z|[-*+>#|`(\[{]|\d|[A-ZÀ-Þ㐀-鿿])"
_KINDS = {
    "h": r"(?<!\w)(?=[0-9a-f]*\d)[0-9a-f]{6,40}(?!\w)",
    "p": r"[\w.-]{0,255}+/[\w./-]*\w",
    "w": r"[A-Za-zÀ-ɏ_$][\wÀ-ɏ$]*(?:-[A-Za-zÀ-ɏ]\w*)*",
    "n": r"\d[\d.,:]*\d|\d",
    "l": r"\n[ \t\r]*(?:\n[ \t\r]*)+|\n[ \t\r]*" + _LINE_START,
    "c": r"[㐀-鿿぀-ヿ가-힯]",
    "s": r"[^\s\w]",
    "o": r"\w",
}
_TOKEN = re.compile("|".join(_KINDS.values()))
_KIND = re.compile("|".join(f"(?P<{k}>{v})" for k, v in _KINDS.items()))
_CAMEL = re.compile(r"[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+$")
_LOWER_CAMEL = re.compile(r"[a-z]+[0-9]*(?:[A-Z][a-z0-9]*)+$")
# Sentence ends, closers that may follow them, marks of a cut.
STOPS = frozenset(".!?。！？…")
CLOSERS = "'\"”’»)）]】*_`"
_HALF = re.compile(r"\w-$")
_CLOCK = re.compile(r"^\d\d:\d\d ", re.M)
_CLOCK_END = re.compile(r"\n\d{1,2}(?::\d{0,2})?$")
_MARK = re.compile(r"(?:…|\.{3,}|[\[(<{](?:…|\.{3}|\s|truncated|cut|cut off|clipped|more|read more|continued|snip|gekürzt|abgeschnitten|截断|未完|省略){1,4}[\])>}])\s*\Z", re.I)
#: A longer run of word characters is no word of a vocabulary (encoded data, long hashes).
LONGEST_WORD = 64
#: Token forms remembered by a worker; beyond, the memory starts anew.
REMEMBERED = 1 << 20


def _form(raw: str) -> str:
    """A token as context: names, numbers and paths by their kind, a line end as newline."""
    if raw[0] == "\n":
        return "\n"
    m = _KIND.fullmatch(raw)
    kind = m.lastgroup if m else "o"
    if kind == "w":
        form = "\u0001C" if _CAMEL.match(raw) else "\u0001c" if _LOWER_CAMEL.match(raw) else raw.lower()
        return "\u0001i" if form[0] != "\u0001" and (any(ch.isdigit() for ch in raw) or "-" in raw or "_" in raw) else form
    if kind == "p":
        return "\u0001P" if "." in raw.rsplit("/", 1)[-1][1:] else "\u0001Q"
    return {"h": "\u0001H", "n": "\u0001N"}.get(kind, raw)


class _Forms(dict):
    """Form and hash of each token seen."""

    def __missing__(self, raw: str) -> tuple[str, int]:
        if len(self) >= REMEMBERED:
            self.clear()
        form = _form(raw)
        out = self[raw] = (form, xxhash.xxh3_64_intdigest(form))
        return out


_forms = _Forms()


def tokens(text: str) -> list[tuple[str, str]]:
    """(form, raw) of each token."""
    return [(_forms[r][0], r) for r in _TOKEN.findall(text)]


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD))


def _chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a context one word longer."""
    with np.errstate(over="ignore"):
        h = left * _MIX[0] ^ right
        h = (h ^ h >> np.uint64(29)) * _MIX[1]
    return h ^ h >> np.uint64(32)


def key(forms: tuple[str, ...]) -> int:
    """The key of up to ``ORDER`` forms, as ``counts`` gives it."""
    h = np.array([len(forms)], np.uint64)
    for f in forms:
        h = _chain(h, np.array([xxhash.xxh3_64_intdigest(f)], np.uint64))
    return int(h.astype(np.int64)[0])


_STOP_HASHES = np.array(sorted(xxhash.xxh3_64_intdigest(f) for f in [*STOPS, "\n"]), np.uint64)


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def counts(texts: list[str | None], hashes: list[int]) -> tuple[tuple, dict[str, list[int]]]:
    """How often contexts end and go on, and in how many texts words stand.

    First (keys, ends, goes on, bits) as arrays, then word -> [texts, bits].
    ``bits``: of each text one bit of 64, chosen by its hash, so that the
    number of different texts can be estimated after any merging, however often
    a text is repeated.  A stretch at the very end of a text is neither an end
    nor does it go on: whether it ends is what is asked.
    """
    flat: list[int] = []
    lengths: list[int] = []
    marks: list[int] = []
    words: dict[str, list[int]] = {}
    newline = xxhash.xxh3_64_intdigest("\n")
    for t, h in zip(texts, hashes):
        if not t:
            continue
        raws = _TOKEN.findall(t)
        bit = h & 63
        flat.append(newline)
        flat += [_forms[r][1] for r in raws]
        lengths.append(len(raws) + 1)
        marks.append(bit)
        own = set(raws[:-1])
        for r in [r for r in own if "/" in r]:
            own.update(re.findall(r"\w+", r))
        for r in own:
            if r[0].isalpha() and len(r) <= LONGEST_WORD:
                n = words.get(r)
                if n is None:
                    words[r] = [1, 1 << bit]
                else:
                    n[0] += 1
                    n[1] |= 1 << bit
    if not flat:
        none = np.empty(0, np.int64)
        return (none, none, none, none), words
    form = np.array(flat, np.uint64)
    first = np.zeros(len(form), np.int64)
    starts = np.cumsum([0, *lengths[:-1]])
    first[starts] = 1
    at = np.arange(len(form)) - starts[np.cumsum(first) - 1]  # place in the text
    bits = np.uint64(1) << np.repeat(np.array(marks, np.uint64), lengths)
    stop = np.isin(form, _STOP_HASHES)
    nxt = np.zeros(len(form), bool)  # the next token exists
    nxt[:-1] = first[1:] == 0
    ended = np.zeros(len(form), bool)
    ended[:-1] = stop[1:]
    real = nxt & ~stop
    keys, ends, marks_ = [], [], []
    for n in range(1, ORDER + 1):
        h = np.full(len(form), n, np.uint64)
        for back in range(n - 1, -1, -1):
            h = _chain(h, np.roll(form, back))
        ok = real & (at >= n - 1)
        keys.append(h[ok])
        ends.append(ended[ok])
        marks_.append(bits[ok])
    k, e, b = np.concatenate(keys), np.concatenate(ends), np.concatenate(marks_)
    if not k.size:
        none = np.empty(0, np.int64)
        return (none, none, none, none), words
    order = np.argsort(k, kind="stable")
    k, e, b = k[order], e[order].astype(np.int64), b[order]
    cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    n_all = np.diff(np.r_[cut, len(k)])
    n_end = np.add.reduceat(e, cut)
    return (k[cut].astype(np.int64), n_end, n_all - n_end, np.bitwise_or.reduceat(b, cut).astype(np.int64)), words


def _tail(t: str) -> str:
    """The end of a text from a white space on, with enough tokens before it for a context."""
    n = 400
    while n < len(t):
        at = re.search(r"\s", t[-n : -n // 2])
        if at:
            return t[len(t) - n + at.start() :]
        n *= 2
    return t


def ending(text: str | None) -> dict | None:
    """What has to be known of a text to judge its end; None if it ends as texts do.

    marked: a mark of a cut stood at the end; sure: cut beyond doubt (a broken
    character, an open code fence or bracket, a comma); path: it is a path
    without an extension; last: the raw last word; keys: of the last 1 to 3 forms,
    then of the last 2 and 3 without the last, 0 for none.
    """
    if not text:
        return None
    t = text.rstrip()
    if t.endswith("�"):
        return {"marked": False, "sure": True, "path": False, "last": "", "keys": [0] * (2 * ORDER - 1)}
    marked = False
    while m := _MARK.search(t[-80:]):
        rest = (t.rstrip(".") if t.endswith("...") else t[: max(0, len(t) - 80) + m.start()]).rstrip()
        if not rest:
            break
        marked, t = True, rest
    bare = t[-64:].rstrip(CLOSERS)
    seq = tokens(_tail(t))
    if bare and bare[-1] in STOPS:
        back = [f for f, _ in seq if f not in CLOSERS]
        # a stop directly behind an unfinished path belongs to its missing extension
        if not (t[-1] == "." and len(back) >= 2 and back[-2] == "\u0001Q"):
            return None
        seq = seq[:-1]
    if not seq:
        return None
    fences = len(re.findall(r"^[ \t]*```", t, re.M)) if "```" in t else 0
    if t.endswith("```") and fences % 2 == 0:
        return None
    line = re.split(r"(?<=[.!?。！？])\s", t.rpartition("\n")[2])[-1]
    opened = any(line.count(a) > line.count(b) for a, b in ("()", "[]", "（）", "{}"))
    sure = fences % 2 == 1 or opened or t[-1] in ",，、;；:：([{（/" or t.endswith(("``", "\\")) or bool(_HALF.search(t[-2:])) or bool(_CLOCK_END.search(t[-8:])) and len(_CLOCK.findall(t)) >= 2
    while seq and seq[-1][0] == "\n":
        seq.pop()
    forms = [f for f, _ in seq]
    if not forms:
        return None
    last = seq[-1][1]
    if "/" in last and len(last) > 1:
        last = re.findall(r"\w+", last)[-1]
    plain = lambda f: f[0].isalpha()
    #: what stands for a kind of name says little alone; list marks and line starts before it say nothing
    told = lambda part: part[-1] == "\u0001Q" or len(part) == ORDER and part[-1][0] == "\u0001" and not set(part[:-1]) & set("\n-*+|(#>") and any(map(plain, part[:-1]))
    forms = ["\n", *forms]
    keys = []
    for n in range(1, ORDER + 1):
        part = tuple(forms[-n:])
        if len(forms) <= n and n > 1 or not (plain(part[-1]) or told(part)):
            keys.append(0)
        else:
            keys.append(key(part))
    keys += [key(tuple(forms[-n:-1])) if keys[n - 1] else 0 for n in range(2, ORDER + 1)]
    word = last[0].isalpha() and len(last) <= LONGEST_WORD and not re.match(r"[㐀-鿿]", last)
    return {"marked": marked, "sure": sure, "path": forms[-1] == "\u0001Q", "last": last if word else "", "keys": keys}
