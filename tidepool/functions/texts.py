"""Text and date rules as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepool.functions.rules import colour  # noqa: F401

#: Ranges of emoji code points; groups of relation names that count as one; patterns of secrets.
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FAFF}\x{2600}-\x{26FF}\x{FE00}-\x{FE0F}\x{200D}]+"
KEYS = (r"sk-[a-zA-Z0-9-]{20,}", r"AIza[a-zA-Z0-9_-]{35}", r"ghp_[a-zA-Z0-9]{36}", r"xoxb-[a-zA-Z0-9-]+")
HANGUL = r"[가-힯ᄀ-ᇿ㄰-㆏]"


#: Particles and articles that a content key leaves out, in the order in which they are tried.
PARTICLES = ("은", "는", "이", "가", "을", "를", "의", "에", "와", "과", "로", "으로", "에서", "까지", "부터", "도", "만", "뿐", "이다", "입니다", "이에요", "예요", "임", r"임\.", "'s", "is", "the", "a", "an")


def repeat_key(text: Column) -> Column:
    """Texts that differ in particles (inside words too), marks and spacing alone have one key of 100 characters at most."""
    out = F.regexp_replace(strip(F.lower(text)), "|".join(PARTICLES), "")
    out = F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{M}\p{N}_\s]", ""), r"\s+", " ")
    return F.substring(strip(out), 1, 100)


def strip(text: Column) -> Column:
    """White space of every kind off both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def truncate(text: Column, most: int, suffix: str = "\n... (truncated)") -> Column:
    cut = F.regexp_replace(F.substring(text, 1, most - len(suffix)), r"\s+$", "")
    return F.when(F.char_length(text) > most, F.concat(cut, F.lit(suffix))).otherwise(text)


def name_key(name: Column) -> Column:
    """Names that differ in case, joiners and spacing alone have one key."""
    return F.trim(F.regexp_replace(F.translate(F.lower(name), "_-()", "    "), r"\s+", " "))


def core_name(name: Column) -> Column:
    """What comes before the first joiner or bracket; a name that begins with one is its own core."""
    return F.when(name.rlike(r"^[_(]"), name).otherwise(F.trim(F.regexp_extract(name, r"^([^_(]+)", 1)))


def content_key(text: Column, n: int = 500) -> Column:
    return F.sha2(F.substring(F.lower(strip(text)), 1, n), 256)


def short_key(text: Column) -> Column:
    return F.md5(F.substring(F.lower(strip(text)), 1, 200))


def without_emoji(text: Column) -> Column:
    return F.regexp_replace(text, EMOJI, "")


def only_emoji(text: Column) -> Column:
    """Whether a text has emoji and, but for white space, nothing else."""
    return text.rlike(EMOJI) & (strip(without_emoji(text)) == "")


def cleaned(text: Column) -> Column:
    """Emoji, smart quotes and bracket tags off, blanks and newlines collapsed; doing it twice changes nothing."""
    out = F.regexp_replace(without_emoji(text), r"[“”]", '"')
    out = F.regexp_replace(F.regexp_replace(out, r"[‘’]", "'"), r"\[[A-Z_]+\]", "")
    return strip(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def redacted(text: Column, mark: str = "[REDACTED_KEY]") -> Column:
    for pattern in KEYS:
        text = F.regexp_replace(text, pattern, F.lit(mark))
    return text


def urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"https?://[^\s<>\"')]+"), F.lit(0))


#: What isn't spoken, and what stays of it, in this order.
UNSPOKEN = (
    (r"\*\*(.+?)\*\*", 1), (r"\*(.+?)\*", 1), (r"`(.+?)`", 1), (r"#{1,6}\s*", 0), (r"\[(.+?)\]\(.+?\)", 1), (r"```[\s\S]*?```", 0),
    (r"[^\p{L}\p{N}_\s,.!?;:'\"()~\-]", 0),
)


def spoken(text: Column) -> Column:
    """A text to be read aloud: without marks of emphasis, headings, links, code fences and symbols."""
    for pattern, kept in UNSPOKEN:
        text = F.regexp_replace(text, pattern, f"${kept}" if kept else "")
    return strip(F.regexp_replace(text, r"\s+", " "))


def style(text: Column, hedges: tuple[str, ...] = ("maybe", "perhaps", "might", "could")) -> Column:
    """struct(hedges, words): the share of sentences with a hedge, and the mean words of a sentence. The text is split once, and its sentences are
    counted in one pass over them."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("hedged"))

    def add(acc: Column, sentence: Column) -> Column:
        hedged = F.exists(F.array(*map(F.lit, hedges)), lambda h: F.contains(sentence, h))
        return F.struct((acc["n"] + 1).alias("n"), (acc["hedged"] + hedged.cast("int")).alias("hedged"))

    sentences = F.aggregate(F.split(F.lower(text), r"[.!?。]"), start, lambda acc, s: F.when(s.rlike(r"\S"), add(acc, s)).otherwise(acc))
    # what ends a sentence ends a word too
    counted = F.array(F.struct(sentences.alias("s"), F.regexp_count(text, F.lit(r"[^\s.!?。]+")).alias("words")))
    share = lambda x, of: F.when(x["s"]["n"] > 0, of / x["s"]["n"]).otherwise(F.lit(0.0))
    return F.element_at(F.transform(counted, lambda x: F.struct(F.round(share(x, x["s"]["hedged"]), 3).alias("hedges"), F.round(share(x, x["words"]), 1).alias("words"))), 1)


def age_label(hours: Column) -> Column:
    days = F.floor(hours / 24)
    unit = lambda n, word: F.concat(n.cast("string"), F.lit(word))
    return (
        F.when(hours < 1, F.lit("just now")).when(hours < 24, unit(F.floor(hours), " hours ago")).when(days < 7, unit(days, " days ago"))
        .when(days < 30, unit(F.floor(days / 7), " weeks ago")).when(days < 365, unit(F.floor(days / 30), " months ago")).otherwise(unit(F.floor(days / 365), " years ago"))
    )


def any_time(text: Column) -> Column:
    """A time in one of several formats, read as UTC where no zone is named; else null."""
    formats = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def abbreviated(text: Column, terms: tuple[tuple[str, str], ...]) -> Column:
    """Terms replaced in their order, wherever they stand; one that begins with a capital is replaced by capitals."""
    for long, short in terms:
        text = F.replace(F.replace(text, F.lit(long.capitalize()), F.lit(short.upper())), F.lit(long), F.lit(short))
    return text


def korean_spacing(text: Column) -> Column:
    """A blank after sentence ends (but for dots in a row), closing brackets, colons and stars before Hangul, and before brackets after it;
    blanks in a row become one."""
    h = HANGUL
    gaps = rf"((?<!\.)\.(?={h})|[!?\])}}:*](?={h})|{h}(?=[\[({{]))"
    return F.regexp_replace(F.regexp_replace(text, " {2,}", " "), gaps, "$1 ")


def chunked(text: Column, most: int = 2000) -> Column:
    """A message as pieces of at most ``most`` characters (a fifth more to keep fenced code whole), cut where it reads best."""
    @F.pandas_udf("array<string>")
    def pieces(column):
        return column.map(lambda x: [] if x is None else split_message(x, most))

    return pieces(text)


def split_message(text: str, most: int) -> list[str]:
    parts, rest = [], text
    while len(rest) > most:
        cut = _cut(rest, most)
        if part := rest[:cut].rstrip():
            parts.append(part)
        rest = rest[cut:].lstrip("\n")
    return [*parts, rest] if rest or not parts else parts


def _cut(text: str, most: int) -> int:
    head = text[:most]
    if head.count("```") % 2:
        # inside fenced code: to its end if that is near, else before it
        begin = head.rfind("```")
        end = text.find("```", begin + 3) + 3
        if 3 <= end <= 1.2 * most:
            return end
        if begin > 0:
            return begin
    for mark in ("\n\n", "\n", ". ", "! ", "? ", " "):
        at = head.rfind(mark)
        if at > most // 2:
            return at + len(mark)
    return most


def korean_age(hours: Column, day: Column) -> Column:
    days = F.floor(hours / 24)
    unit = lambda n, word: F.concat(n.cast("string"), F.lit(word))
    return (
        F.when(hours < 1, F.lit("방금")).when(hours < 24, unit(F.floor(hours), "시간 전")).when(days == 1, F.lit("어제")).when(days < 7, unit(days, "일 전"))
        .when(days < 30, unit(F.floor(days / 7), "주 전")).when(days < 365, unit(F.floor(days / 30), "개월 전")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    )


def summary(text: Column, title: Column, paragraphs: int = 4, most: int = 500) -> Column:
    """The title and the first sentences of the first paragraphs."""
    parts = F.slice(F.filter(F.split(text, r"\n\s*\n|\n"), lambda p: F.char_length(F.trim(p)) > 20), 1, paragraphs)
    firsts = F.transform(parts, lambda p: F.regexp_extract(strip(p), r"(?s)^(.*?[.!?])(?:\s|$)|^(.*)$", 0))
    return F.substring(F.concat_ws("\n", title, F.array_join(F.transform(firsts, strip), " ")), 1, most)


def elapsed_label(seconds: Column, short: bool = True) -> Column:
    """Six bands of the time since the last message; without the ``short`` ones of under six hours, all of less than a day is a new session.
    Units are whole ones, towards zero, so a time to come has negative ones there."""
    unit = lambda n, word: F.concat((seconds / n).cast("long").cast("string"), F.lit(word))
    label = F
    if short:
        label = F.when(seconds < 30, F.lit("")).when(seconds < 300, F.concat(F.lit("pause of "), unit(60, " minutes"))).when(seconds < 3600, F.concat(F.lit("resumed after "), unit(60, " minutes")))
        label = label.when(seconds < 21_600, F.concat(F.lit("back after "), unit(3600, " hours")))
    return label.when(seconds < 86_400, F.concat(F.lit("new session after "), unit(3600, " hours"))).otherwise(F.concat(F.lit("back after "), unit(86_400, " days")))
