"""Text expressions. Every function takes and returns columns and stays within the JVM; null in, null out unless said otherwise."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache, reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X

#: First code point of the Hangul syllables and of the letters they are made of; how many syllables share a first letter, and a first and second.
_HANGUL, _LEAD, _VOWEL, _TAIL = 0xAC00, 0x1100, 0x1161, 0x11A7
_PER_LEAD, _PER_VOWEL = 588, 28


@lru_cache(4)
def _forms(form: str, keep_marks: bool) -> dict[str, str]:
    """What normalisation makes of every code point that it changes. Hangul syllables follow a rule of their own."""
    out = {}
    for n in range(0x80, 0x110000):
        if 0xD800 <= n <= 0xDFFF or _HANGUL <= n < _HANGUL + 19 * _PER_LEAD:
            continue
        c = chr(n)
        t = unicodedata.normalize(form, c)
        t = t if keep_marks else "".join(x for x in t if not unicodedata.combining(x))
        if t != c:
            out[c] = t
    return out


@lru_cache(4)
def _letters(form: str, keep_marks: bool) -> tuple[str, str]:
    """For translate: characters that become one, and which; then those that go."""
    found = _forms(form, keep_marks)
    one, none = [c for c, t in found.items() if len(t) == 1], [c for c, t in found.items() if not t]
    return "".join(one + none), "".join(found[c] for c in one)


@lru_cache(4)
def _several(form: str, keep_marks: bool) -> tuple[str, list[str]]:
    """For translate: characters that become several, those of most first; their first, second, ... characters, shorter ones being at their end."""
    found = {c: t for c, t in _forms(form, keep_marks).items() if len(t) > 1}
    order = sorted(found, key=lambda c: (-len(found[c]), c))
    return "".join(order), ["".join(found[c][k] for c in order if len(found[c]) > k) for k in range(max(map(len, found.values())))]


@lru_cache(8)
def _class(chars: str, hangul: bool = False) -> str:
    """A pattern's class of these characters, as ranges."""
    points = sorted(set(map(ord, chars)) | (set(range(_HANGUL, _HANGUL + 19 * _PER_LEAD)) if hangul else set()))
    starts = [p for i, p in enumerate(points) if not i or points[i - 1] != p - 1]
    ends = [p for i, p in enumerate(points) if i + 1 == len(points) or points[i + 1] != p + 1]
    return "[" + "".join(f"\\x{{{a:X}}}" if a == z else f"\\x{{{a:X}}}-\\x{{{z:X}}}" for a, z in zip(starts, ends, strict=True)) + "]"


@lru_cache(1)
def _references() -> tuple[str, str, str]:
    """Names with their semicolon by first two letters, as JSON; a pattern of the names that need none, longest first; those by name, as JSON."""
    nested: dict = {}
    for k, v in html5.items():
        nested.setdefault(k[:2], {})[k] = v
    bare = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
    return json.dumps(nested, ensure_ascii=False), "^(" + "|".join(bare) + ")", json.dumps({k: html5[k] for k in bare}, ensure_ascii=False)


@lru_cache(1)
def _odd_numbers() -> str:
    """Numbers of references that stand for another character or for none, as JSON."""
    odd = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)} | {0: "\ufffd", 13: "\r"}
    none = [*range(1, 9), 11, *range(14, 32), 127, *range(0xFDD0, 0xFDF0), *[p << 16 | low for p in range(17) for low in (0xFFFE, 0xFFFF)]]
    return json.dumps({str(n): "" for n in none} | {str(n): t for n, t in odd.items()}, ensure_ascii=False)


def _lookup(table: str, key: Column) -> Column:
    return F.try_element_at(F.from_json(F.lit(table), "map<string,string>"), key)


def _point(n: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(c: Column, f) -> Column:
    """f(c) with ``c`` computed once, however often ``f`` uses it: plans stay small where expressions nest."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _replace_all(c: Column, table: dict[str, str]) -> Column:
    for old, new in table.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def strip_accents(c: Column) -> Column:
    """Compatibility decomposition without its combining marks."""
    return _normalised(c, "NFKD", False)


def nfkc(c: Column) -> Column:
    """Compatibility composition, character by character."""
    return _normalised(c, "NFKC", True)


def _normalised(c: Column, form: str, keep_marks: bool) -> Column:
    source, target = _letters(form, keep_marks)
    long, parts = _several(form, keep_marks)
    some = _class(long, hangul=not keep_marks)
    syllables = f"[{chr(_HANGUL)}-{chr(_HANGUL + 19 * _PER_LEAD - 1)}]"

    def syllable(ch: Column) -> Column:
        n = F.ascii(ch) - _HANGUL
        tail = F.when(n % _PER_VOWEL > 0, _point(n % _PER_VOWEL + _TAIL)).otherwise("")
        return F.concat(_point(F.floor(n / _PER_LEAD) + _LEAD), _point(F.floor(n % _PER_LEAD / _PER_VOWEL) + _VOWEL), tail)

    def expanded(ch: Column) -> Column:
        out = F.concat(*[F.translate(ch, long, p) for p in parts])
        return out if keep_marks else F.when(ch.between(chr(_HANGUL), chr(_HANGUL + 19 * _PER_LEAD - 1)), syllable(ch)).otherwise(out)

    # A piece is a character of several and what follows it; the first may lack that character.
    one = lambda p: F.when(p.rlike(f"^{some}"), F.concat(expanded(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))).otherwise(p)
    pieces = lambda t: F.array_join(F.transform(F.split(t, f"(?={some})"), one), "")
    # Whether there is one tells a table at once, where a class of a thousand ranges would try them at every character.
    has = lambda t: (F.translate(t, long, "") != t) | (F.lit(not keep_marks) & t.rlike(syllables))
    longer = lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), F.when(has(t), pieces(t)).otherwise(t)).otherwise(t)
    # Most texts are plain, and cost one look.
    return let(c, lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), let(F.translate(t, source, target), longer)).otherwise(t))


def fold(c: Column, flatten: bool = False) -> Column:
    """Lower case without accents; ``flatten``: every run of other than a-z and 0-9 is one space."""
    c = F.lower(strip_accents(_or_empty(c)))
    return F.trim(F.regexp_replace(c, "[^0-9a-z]+", " ")) if flatten else F.trim(c)


def slugify(c: Column) -> Column:
    def slug(t: Column) -> Column:
        other = F.regexp_replace(F.regexp_replace(t, r"(?U)[^\w\s-]", " "), r"(?U)[\s_-]+", "-")
        # Of plain characters, letters and digits stay, and no class of all characters is asked.
        plain = F.btrim(F.regexp_replace(t, "[^0-9a-z]+", "-"), F.lit("-"))
        return F.when(t.rlike(r"[^\x00-\x7F]"), F.regexp_replace(other, "^-+|-+$", "")).otherwise(plain)

    return let(F.lower(strip_accents(_or_empty(c))), slug)


def title_key(c: Column) -> Column:
    """The part of a title that identifies it: its slug without badges and articles."""

    def key(slug: Column) -> Column:
        words = F.replace(slug, F.lit("-"), F.lit(" "))
        other = F.regexp_replace(F.regexp_replace(words, "(?U)" + X.BADGES, " "), "(?U)" + X.ARTICLES, " ")
        plain = F.btrim(F.regexp_replace(F.regexp_replace(words, f"{X.BADGES}|{X.ARTICLES}", " "), " +", "-"), F.lit("-"))
        return F.when(slug.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.regexp_replace(other, r"[\s-]+", "-"), "^-+|-+$", "")).otherwise(plain)

    return let(slugify(c), key)


def fingerprint(title: Column, start: Column, town: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", title_key(title), start.cast("string"), slugify(town)).cast("binary")), 1, 16)


def _first(rules: list[tuple[Column, str]]) -> Column:
    out = None
    for when, value in rules:
        out = F.when(when, value) if out is None else out.when(when, value)
    return out


def _alternatives(pattern: str) -> list[str]:
    """What stands between a pattern's outer bars."""
    out, depth = [""], 0
    for c in pattern:
        depth += (c in "([") - (c in ")]")
        out = [*out, ""] if c == "|" and not depth else [*out[:-1], out[-1] + c]
    return out


def _stem(alternative: str) -> str:
    """The longest text that whatever matches must hold."""
    bare = re.sub(r"\\.|\[[^\]]*\][?*+]?|\([^)]*\)[?*+]?|.[?*]|[.+^$]", "\0", alternative)
    return max(bare.split("\0"), key=len)


def _says(h: Column, pattern: str) -> Column:
    """Whether a text matches: a look for plain words, and for a pattern only where its stem is there."""
    tests = [h.contains(a) if re.fullmatch(r"[\w '-]+", a) else h.contains(_stem(a)) & h.rlike("(?U)" + a) for a in _alternatives(pattern)]
    return reduce(lambda a, b: a | b, tests)


def classify(*parts: Column) -> Column:
    """The category of the first pattern that short texts match; else the default."""
    hay = F.lower(strip_accents(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])))
    return let(hay, lambda h: _first([(_says(h, p), k) for p, k in X.CATEGORY_PATTERNS]).otherwise(X.DEFAULT_CATEGORY))


def category_from_type(label: Column) -> Column:
    hay = F.lower(strip_accents(_or_empty(label)))
    return let(hay, lambda h: _first([(h.contains(w), k) for w, k in X.TYPE_WORDS]))


def is_nonevent(title: Column) -> Column:
    return fold(title).rlike("(?U)" + "|".join(X.NON_EVENT_PATTERNS))


def says_cancelled(title: Column) -> Column:
    return fold(title).rlike("(?U)" + X.SAYS_CANCELLED)


def strip_marker(title: Column) -> Column:
    """A title without its leading cancellation marker; the whole if nothing else is left."""
    out = F.regexp_replace(F.regexp_replace(title, "(?U)" + X.CANCEL_MARKER, ""), r"^[ \-–—:·,]+|[ \-–—:·,]+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), title)


def canon_town(raw: Column, postcode: Column | None = None) -> Column:
    """Canonical town of a messy name or postcode; what cannot be told stays as it is, 'Unknown' if empty."""
    lookup = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    bare = F.when(F.trim(raw).rlike(r"^\d{5}$"), F.trim(raw))
    code = F.coalesce(F.nullif(F.trim(postcode.cast("string")), F.lit("")), bare) if postcode is not None else bare
    by_name = F.try_element_at(lookup(X.TOWNS), slugify(raw))
    return F.coalesce(by_name, F.try_element_at(lookup(X.POSTCODES), F.substring(code, 1, 5)), F.nullif(F.trim(raw), F.lit("")), F.lit("Unknown"))


def looks_like_commune(town: Column) -> Column:
    return ~F.split(slugify(town), "-")[0].isin(X.VENUE_WORDS)


def upper_ratio(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{Lu}]", "")) / F.greatest(F.length(F.regexp_replace(c, r"[^\p{L}]", "")), F.lit(1))


def title_penalty(title: Column) -> Column:
    """Shouting 10, a badge 5, debris 2."""
    debris = title.rlike(X.TITLE_DEBRIS)
    return F.when(upper_ratio(title) > 0.7, 10).otherwise(0) + F.when(title.rlike(X.TITLE_BADGE), 5).otherwise(0) + F.when(debris, 2).otherwise(0)


def richer(new: Column, old: Column) -> Column:
    """The longer of two texts, the old one among equals; an empty one never wins."""
    new, old = F.nullif(new, F.lit("")), F.nullif(old, F.lit(""))
    return F.when(old.isNull() | (F.length(new) > F.length(old)), new).otherwise(old)


def venue_core(venue: Column) -> Column:
    return slugify(F.split_part(_or_empty(venue), F.lit(","), F.lit(1)))


#: What can be a reference, as browsers read it.
_REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def unescape(c: Column) -> Column:
    """Character references, named and numeric, as what they stand for; unknown ones stay. Each is read once.

    A name may lack its semicolon where the standard says so; of such names the longest that fits counts, and the rest of the word stays.
    """
    names, bare, by_bare = _references()

    def numeric(found: Column) -> Column:
        hexed = found.rlike("^#[xX]")
        digits = F.regexp_replace(F.regexp_replace(found, "^#[xX]?0*|;$", ""), "^$", "0")
        # Nine digits or more are beyond all characters in either base.
        code = F.when(F.length(digits) < 9, F.when(hexed, F.conv(digits, 16, 10)).otherwise(digits).cast("long"))
        sound = code.between(0, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.coalesce(_lookup(_odd_numbers(), code.cast("string")), F.when(sound, _point(code)), F.lit("\ufffd"))

    def named(found: Column) -> Column:
        whole = F.try_element_at(F.try_element_at(F.from_json(F.lit(names), "map<string,map<string,string>>"), F.substring(found, 1, 2)), found)
        first = F.regexp_extract(found, bare, 1)
        longest = F.when(first != "", F.concat(_lookup(by_bare, first), F.substring(found, F.length(first) + 1, F.lit(40))))
        return F.coalesce(whole, longest, F.concat(F.lit("&"), found))

    def one(found: Column) -> Column:
        return F.when(found.startswith("#"), numeric(found)).otherwise(named(found))

    def whole(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(_REFERENCE), F.lit(1)), one)
        parts = F.zip_with(F.split(t, _REFERENCE), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        return F.when(t.contains("&"), F.array_join(parts, "")).otherwise(t)

    return let(c, whole)


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def tidy_text(c: Column) -> Column:
    c = _replace_all(nfkc(unescape(_or_empty(c))), {"**": "", "__": ""})
    c = F.regexp_replace(c, r"\[([^\]]+)\]\([^)]+\)", "$1")
    return _squeeze(F.regexp_replace(F.regexp_replace(c, r"#{1,6}\s*", ""), r"(?U)\s*[—–]\s*", " - "))


def _capital(w: Column) -> Column:
    part = lambda i: F.regexp_extract(w, r"^([^\p{L}]*)(\p{L})(.*)$", i)
    return F.concat(part(1), F.upper(part(2)), F.lower(part(3)))


def deshout(c: Column) -> Column:
    """Case for a title whose letters are capitals by three fifths or more; acronyms, numerals and initials stay."""

    def word(w: Column, i: Column) -> Column:
        core = F.regexp_replace(w, r"""^[.,!?:;"'()\[\]«»]+|[.,!?:;"'()\[\]«»]+$""", "")
        first = (i == 0) | w.rlike(r"""^["'(«\[]""")
        keep = ~core.rlike(r"^\p{L}+$") | F.upper(core).isin(X.KEEP_CAPS) | core.rlike(X.ROMAN) | ((F.length(core) <= 5) & ~core.rlike(X.VOWEL))
        return F.when(keep, w).when(~first & F.lower(core).isin(X.JOINERS), F.lower(w)).when(~first & (F.length(core) <= 2), w).otherwise(_capital(w))

    def whole(t: Column) -> Column:
        loud = lambda letters: (F.length(letters) >= 6) & (F.length(F.regexp_replace(letters, r"[^\p{Lu}]", "")) / F.length(letters) >= 0.6)
        return F.when(let(F.regexp_replace(t, r"[^\p{L}]+", ""), loud), F.array_join(F.transform(F.split(_squeeze(t), " "), word), " ")).otherwise(t)

    return let(c, whole)


def unshout_words(c: Column) -> Column:
    """Each run of three or more capitals becomes a word, unless it is an acronym, a numeral or has no vowel."""
    caps = "[A-ZÀ-ÖØ-Þ]"
    runs = lambda t: F.split(t, f"(?<={caps})(?!{caps})|(?<!{caps})(?={caps})")

    def word(w: Column) -> Column:
        change = w.rlike(f"^{caps}{{3,}}$") & ~w.isin(X.KEEP_CAPS) & ~w.rlike(X.ROMAN) & w.rlike(X.VOWEL)
        return F.when(change, F.concat(F.substring(w, 1, 1), F.lower(F.substring(w, 2, 1 << 30)))).otherwise(w)

    return let(c, lambda t: F.when(t.rlike(f"{caps}{{3}}"), F.array_join(F.transform(runs(t), word), "")).otherwise(t))


def _close(opened: str, closed: str):
    def close(c: Column) -> Column:
        count = lambda ch: F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))
        missing = count(opened) - count(closed)
        bare = F.rtrim(c)
        dangling = F.rtrim(F.substring(bare, F.lit(1), F.length(bare) - 1))
        filled = F.concat(F.regexp_replace(bare, "[!?.,;:]+$", ""), F.repeat(F.lit(closed), missing))
        return F.when(missing <= 0, c).when(bare.endswith(opened), dangling).otherwise(filled)

    return close


def close_brackets(c: Column) -> Column:
    """Closers for brackets left open; an opener with nothing after it goes."""
    for pair in (("(", ")"), ("[", "]"), ("«", "»")):
        c = let(c, _close(*pair))
    return c


def clean_title(c: Column) -> Column:
    c = _squeeze(F.regexp_replace(tidy_text(c), X.EMOJI, " "))
    c = F.trim(F.regexp_replace(F.regexp_replace(c, r"^[-–—·|]+\s*", ""), r"\s+[-–—·|]+$", ""))
    return F.trim(close_brackets(unshout_words(deshout(c))))


def time_from_title(title: Column, stored: Column) -> tuple[Column, Column]:
    """(title, time) with a clock time moved from the title to the time, where no other time is stored."""
    group = lambda i: F.nullif(F.regexp_extract(title, X.CLOCK_IN_TITLE, i), F.lit(""))
    hour, minute = F.coalesce(group(1), group(3)).cast("int"), F.coalesce(group(2), group(4), F.lit("0")).cast("int")
    found = F.when((hour <= 23) & (minute <= 59), F.format_string("%02d:%02d", hour, minute))
    kept = F.nullif(stored, F.lit(""))
    lift = found.isNotNull() & (kept.isNull() | (kept == "00:00") | (kept == found))
    rest = F.regexp_replace(title, "(?s)^(.*?)" + X.CLOCK_IN_TITLE.removeprefix("(?U)"), "$1 ")
    rest = F.regexp_replace(F.regexp_replace(rest, r"\s+", " "), r"\s+([-–—·:,])\s*$", "")
    rest = F.regexp_replace(rest, r"^[ \-–—·:,]+|[ \-–—·:,]+$", "")
    enough = F.length(F.regexp_replace(rest, r"[^\p{L}]", "")) >= 3
    return F.when(lift & enough, rest).otherwise(title), F.when(lift, found).otherwise(stored)


def note_full(c: Column) -> Column:
    """A note without leading time, category label and bare times; empty if it is only a time."""
    lead = X.NOTE_LEAD

    def unlabelled(t: Column) -> Column:
        return F.when(F.lower(strip_accents(F.regexp_extract(t, lead, 1))).isin(X.NOTE_LABELS), F.trim(F.regexp_replace(t, lead, ""))).otherwise(t)

    def timeless(t: Column) -> Column:
        parts = F.filter(F.transform(F.split(t, "·"), lambda x: F.trim(x)), lambda p: (p != "") & ~p.rlike(X.BARE_CLOCK))
        return F.when(t.contains("·"), F.array_join(parts, " · ")).otherwise(t)

    def whole(t: Column) -> Column:
        body = F.trim(F.regexp_replace(t, X.NOTE_TIMES, ""))
        return F.when(t.rlike(X.BARE_CLOCK), F.lit("")).otherwise(let(let(body, unlabelled), timeless))

    return let(tidy_text(c), whole)


def shorten(c: Column, limit: int = X.NOTE_CHARS) -> Column:
    """The text up to the last sentence end after 60 characters, else the last word after 40, within the limit."""

    def cut(t: Column) -> Column:
        window = F.substring(t, 1, limit + 1)

        def last(mark: str) -> Column:
            """0-based place of the last ``mark``; -1 if there is none."""
            at = F.instr(F.reverse(window), mark[::-1])
            return F.when(at > 0, F.length(window) - at - (len(mark) - 1)).otherwise(-1)

        ends = [F.when(last(m) >= 60, F.trim(F.substring(t, F.lit(1), last(m) + 1))) for m in (". ", "! ", "? ", "; ")]
        stop = F.when(last(" ") < 40, F.lit(limit)).otherwise(last(" "))
        hard = F.concat(F.regexp_replace(F.substring(t, F.lit(1), stop), r"[ ,;:·\-–—]+$", ""), F.lit("…"))
        return F.when(F.length(t) <= limit, t).otherwise(F.coalesce(*ends, hard))

    return let(c, cut)


def card_slug(title: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(F.lower(strip_accents(_or_empty(title))), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: w != "")
    kept = lambda ws: F.filter(ws, lambda w: ~w.isin(X.CARD_STOP) & (F.length(w) > 1))
    return let(words, lambda ws: F.array_join(F.slice(F.when(F.size(kept(ws)) > 0, kept(ws)).otherwise(ws), 1, 2), "-"))


def says_free(text: Column) -> Column:
    return text.rlike(X.SAYS_FREE) & ~text.rlike(X.SAYS_PRICE)


def title_similarity(a: Column, b: Column) -> Column:
    """1 where one folded title holds the other, else the Jaccard similarity of their words; 0 if one is empty."""

    def compare(a: Column, b: Column) -> Column:
        x, y = F.split(a, " "), F.split(b, " ")
        share = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
        return F.when((a == "") | (b == ""), F.lit(0.0)).when(a.contains(b) | b.contains(a), F.lit(1.0)).otherwise(share)

    return let(fold(a, flatten=True), lambda x: let(fold(b, flatten=True), lambda y: compare(x, y)))


def title_case(c: Column) -> Column:
    """A capital after every character that is not a letter, the rest in lower case."""
    runs = F.split(c, r"(?<=\p{L})(?!\p{L})|(?<!\p{L})(?=\p{L})")
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def html_escape(c: Column) -> Column:
    return _replace_all(c, {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#x27;"})


def script_escape(c: Column) -> Column:
    """JSON that can stand inside a script element."""
    return _replace_all(c, {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026"})


def is_online(title: Column, venue: Column, event_type: Column, flagged: Column) -> Column:
    """A structured flag, the type, a virtual venue, or a bracketed marker in the title."""
    venue_says, title_says = _or_empty(venue).rlike(X.ONLINE_VENUE), _or_empty(title).rlike(X.ONLINE_TITLE)
    return F.coalesce(flagged, F.lit(False)) | F.upper(_or_empty(event_type)).isin("ONLINE", "VIRTUAL") | venue_says | title_says


# --- descriptions of calendar entries


def segments(text: Column) -> Column:
    """Parts between bullets or wide gaps."""
    raw = F.regexp_replace(unescape(F.regexp_replace(_or_empty(text), "<[^>]+>", " ")), r"\s+:", " :")
    return F.filter(F.transform(F.split(raw, X.SEGMENT_ENDS), lambda x: F.trim(x)), lambda s: s != "")


def time_from_text(text: Column) -> Column:
    """The first explicit start ('de 21h00 à', 'à partir de 19h') outside segments on a class beforehand."""
    span = X.FROM_TO_HOURS
    since = X.FROM_HOUR
    main = F.filter(segments(text), lambda s: ~s.rlike(X.CLASS_BEFORE))

    def clock(s: Column) -> Column:
        pick = lambda i: F.when(s.rlike(span), F.regexp_extract(s, span, i)).otherwise(F.regexp_extract(s, since, i))
        hour, minute = F.nullif(pick(1), F.lit("")).cast("int"), F.coalesce(F.nullif(pick(2), F.lit("")).cast("int"), F.lit(0))
        return F.when((hour <= 23) & (minute <= 59), F.format_string("%02d:%02d", hour, minute))

    return F.try_element_at(F.filter(F.transform(main, clock), lambda t: t.isNotNull()), F.lit(1))


def price_from_text(text: Column, most: int = 45) -> Column:
    price = lambda s: F.regexp_replace(F.regexp_extract(s, X.PRICE_LINE, 1), r"^[ .:\-–]+|[ .:\-–]+$", "")
    good = lambda p: (p != "") & (F.length(p) <= most) & p.rlike(X.PRICE_WORDS)
    return F.try_element_at(F.filter(F.transform(segments(text), price), good), F.lit(1))


def location_parts(location: Column) -> Column:
    """Struct (venue, city, postcode): the last postcode parts the two; without one all is the venue."""
    trimmed = lambda c: F.nullif(F.btrim(c, F.lit(" ,.-")), F.lit(""))
    none = F.lit(None).cast("string")

    def parts(s: Column, head: Column) -> Column:
        rest = F.substring(s, F.length(head) + 1, F.length(s))
        city = trimmed(F.substring_index(F.translate(rest, "\n", ","), ",", 1))
        return F.when(head == "", F.struct(F.nullif(F.trim(s), F.lit("")).alias("venue"), none.alias("city"), none.alias("postcode"))).otherwise(
            F.struct(trimmed(F.substring(head, F.lit(1), F.length(head) - 5)).alias("venue"), city.alias("city"), F.right(head, F.lit(5)).alias("postcode"))
        )

    # The pattern is tried once: what follows from it are places in the text.
    return let(location, lambda s: let(F.regexp_extract(s, X.TO_POSTCODE, 1), lambda head: parts(s, head)))


def split_location(location: Column) -> tuple[Column, Column, Column]:
    """(venue, city, postcode) of a location."""
    parts = location_parts(location)
    return parts["venue"], parts["city"], parts["postcode"]


def visible_note(c: Column) -> Column:
    """Text of a description without markup."""
    return F.nullif(F.trim(F.regexp_replace(unescape(F.regexp_replace(_or_empty(c), "<[^>]+>", " ")), r"\s+", " ")), F.lit(""))
