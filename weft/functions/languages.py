"""Language of a text by scripts and frequent words, as one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code point ranges of scripts, in the order they are tried.
SCRIPTS = (
    ("Hangul", "Korean", "가-힯ᄀ-ᇿ"),
    ("Hebrew", "Hebrew", "֐-׿"),
    ("Thai", "Thai", "฀-๿"),
    ("Devanagari", "Hindi", "ऀ-ॿ"),
    ("Bengali", "Bengali", "ঀ-৿"),
    ("Gurmukhi", "Punjabi", "਀-੿"),
    ("Gujarati", "Gujarati", "઀-૿"),
    ("Tamil", "Tamil", "஀-௿"),
    ("Telugu", "Telugu", "ఀ-౿"),
    ("Kannada", "Kannada", "ಀ-೿"),
    ("Malayalam", "Malayalam", "ഀ-ൿ"),
    ("Sinhala", "Sinhala", "඀-෿"),
    ("Lao", "Lao", "຀-໿"),
    ("Myanmar", "Burmese", "က-႟"),
    ("Khmer", "Khmer", "ក-៿"),
    ("Georgian", "Georgian", "Ⴀ-ჿ"),
    ("Armenian", "Armenian", "԰-֏"),
    ("Ethiopic", "Amharic", "ሀ-፿"),
    ("Tibetan", "Tibetan", "ༀ-࿿"),
    ("Cyrillic", "Russian", "Ѐ-ӿ"),
    ("Greek", "Greek", "Ͱ-Ͽ"),
)
# Latin-script languages in the order they are tried: letters that must stand in the lower-cased text, words of
# which one must, and letters that do instead of a word.
LATIN: tuple[tuple[str, str, str, str], ...] = (
    ("Vietnamese", "ảạắằẳẵặấầẩẫậđẻẽẹếềểễệỉĩịỏọốồổỗộơớờởỡợủũụưứừửữựỷỹỵ", "", ""),
    ("Turkish", "ğış", "bir ve için ile bu da de değil ama", ""),
    ("Polish", "ąćęłńśźż", "", ""),
    ("Czech", "ěšžřďťňů", "", ""),
    ("Romanian", "ăâîșț", "și este sau care pentru", ""),
    ("Hungarian", "őű", "", ""),
    ("German", "", "und der die das ist", ""),
    ("French", "", "le la les est une des", ""),
    ("Portuguese", "ãõç", "o a os as de do da é em um uma não que", ""),
    ("Spanish", "", "el los las del por", "ñ¿¡"),
    ("Italian", "", "il della gli che è", ""),
    ("Dutch", "", "het een van dat", ""),
    ("Swedish", "åäö", "och att det en ett är för med", ""),
    ("Norwegian", "åæø", "og er det en et for med på", ""),
    ("Danish", "åæø", "og er det en et til med af", ""),
    ("Finnish", "äö", "ja on ei se että tai kun niin", ""),
    ("Indonesian", "", "yang dari untuk dengan adalah", ""),
    ("Swahili", "", "na ya wa ni kwa katika hii hiyo", ""),
)


def _bounded(word: str) -> str:
    """A word between ASCII word boundaries: before a letter beyond ASCII that means behind an ASCII one."""
    edge = lambda c, ahead: ("(?!" if ahead else "(?<!") + "[A-Za-z0-9_])" if c.isascii() else ("(?=" if ahead else "(?<=") + "[A-Za-z0-9_])"
    return edge(word[0], False) + word + edge(word[-1], True)


_HAN, _KANA, _ARABIC = "㐀-鿿", "぀-ヿ", "؀-ۿ"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once for a row, however often it's used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def detect(text: Column) -> Column:
    """The language of a text: Japanese where kana and Han meet, else the script with the most characters if it has two (ties:
    the first of the table; Persian by its own letters), else the first Latin rule that holds, else English.

    A text is read a fixed few times, not once for each script and rule: for its characters behind U+036F (all scripts are there), its characters beyond ASCII, and
    its runs of ASCII letters, digits and underscores that are words of a rule; the rules look at these."""
    listed = sorted({w for _, _, words, _ in LATIN for w in words.split() if w.isascii()})
    first = F.struct(F.regexp_replace(text, r"[\x00-\u036F]+", "").alias("script"), F.lower(text).alias("low"))
    beyond = lambda v: F.regexp_replace(v["low"], r"[\x00-\x7F]+", "")
    spoken = lambda v: F.array_intersect(F.split(v["low"], r"\W+"), F.array(*map(F.lit, listed)))
    return _once(first, lambda v: _once(F.struct(v["script"].alias("script"), v["low"].alias("low"), beyond(v).alias("beyond"), spoken(v).alias("words")), _by_rules))


def _by_rules(v: Column) -> Column:
    """The language by a text's characters that may be of the scripts, its lower case, that beyond ASCII, and the ASCII words of the rules in it."""
    count = lambda ranges: F.regexp_count(v["script"], F.lit(f"[{ranges}]"))
    han, kana = count(_HAN), count(_KANA)
    scripts = [("Chinese", han), ("Japanese", kana), ("Arabic", count(_ARABIC)), *[(language, count(ranges)) for _, language, ranges in SCRIPTS]]
    best = F.array_max(F.array(*[F.struct(n.alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, n) in enumerate(scripts)]))
    most = lambda b: F.when((b["n"] >= 2) & (b["name"] == "Arabic") & (count("پچژگ") > 0), "Persian").when(b["n"] >= 2, b["name"])
    by_script = F.when(F.char_length(v["script"]) >= 2, F.when((kana > 0) & (han > 0), "Japanese").otherwise(_once(best, most)))
    by_words = None
    for language, letters, words, instead in LATIN:
        rule = F.lit(True)
        if letters:
            rule = rule & v["beyond"].rlike(f"[{letters}]")
        if words:
            plain, other = [w for w in words.split() if w.isascii()], [w for w in words.split() if not w.isascii()]
            said = F.arrays_overlap(v["words"], F.array(*map(F.lit, plain)))
            if other:
                signs = "".join(sorted({c for w in other for c in w if not c.isascii()}))
                said = said | (v["beyond"].rlike(f"[{signs}]") & v["low"].rlike("|".join(map(_bounded, other))))
            rule = rule & (said | v["beyond"].rlike(f"[{instead}]") if instead else said)
        by_words = F.when(rule, language) if by_words is None else by_words.when(rule, language)
    return F.coalesce(by_script, by_words.otherwise("English"))
