"""Problem 2: one form for texts that a reader cannot tell apart."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import materialize
from ..operators.skew import spread_join
from ..session import table
from .texts import dealt, meet, pairs_within

# Letters of other scripts and alphabets with the ASCII letter they look like. Of Greek, Cyrillic, Armenian,
# Cherokee, Coptic and Lisu all that the Unicode confusables data give one ASCII letter; of Latin and others a choice.
LOOKALIKES = {
    "a": "аɑα", "b": "ЬƅᏏ", "c": "сϲᴄⲥꮯ", "d": "ԁɗᏧꓒ", "e": "еҽ", "f": "ϝք", "g": "ɡց", "h": "һհᏂ", "i": "іıɩιᎥꙇꭵ", "j": "јϳ", 
    "l": "ӏǀ", "n": "ոռ", "o": "оοօᴏσⲟ", "p": "рρϱⲣ", "q": "ԛգզ", "r": "гᴦⲅꮁ", "s": "ѕꜱꮪ", "u": "υսᴜ", "v": "νѵᴠꮩ",
    "w": "ԝѡաᴡꮃ", "x": "хχ", "y": "уγүʏ", "z": "ᴢꮓ",
    "A": "АΑᎪꓮ", "B": "ВΒᏴꓐ", "C": "СϹᏟⲤꓚ", "D": "Ꭰꓓ", "E": "ЕΕᎬꓰ", "F": "Ϝꓝ", "G": "ԌᏀᏳꓖ", "H": "НΗᎻⲎꓧ", "I": "ІΙӀⲒꓲ", "J": "ЈͿᎫꓙ", "K": "КΚᏦⲔꓗ",
    "L": "ᏞⳐꓡ", "M": "МΜᎷϺⲘꓟ", "N": "ΝⲚꓠ", "O": "ОΟՕⲞꓳ", "P": "РΡᏢⲢꓑ", "Q": "Ԛ", "R": "ᎡᏒꓣ", "S": "ЅՏᏚᏕꓢ", "T": "ТΤᎢⲦꓔ", "U": "Սᑌꓴ", "V": "ѴᏙꓦ", "W": "ԜᎳᏔꓪ",
    "X": "ХΧⲬꓫ", "Y": "ҮΥϒУᎩᎽⲨꓬ", "Z": "ΖᏃꓜ",
}
# Characters without ink besides those of category Cf.
UNSEEN = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"
#: Texts that may not be their own form: any other is ASCII without a hidden label.
ODD = r"[^\x00-\x7F]|(?i:xn--)"
_TAGS = {"<wide>", "<narrow>", "<noBreak>", "<font>"}


def unseen(ch: str) -> bool:
    return unicodedata.category(ch) == "Cf" or ch in UNSEEN or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef"


def plain_string(ch: str) -> str:
    """What a single character reads as by its Unicode data: nothing, a blank, its form of usual width, or its letter and accents."""
    if ch < "\x80":
        return ch
    if unseen(ch):
        return ""
    if unicodedata.category(ch) in ("Zs", "Zl", "Zp"):
        return " "
    tag, _, codes = unicodedata.decomposition(ch).rpartition("> ")
    if tag and tag + ">" in _TAGS:
        return "".join(map(plain_string, (chr(int(c, 16)) for c in codes.split())))
    if tag == "<compat" and unicodedata.category(ch)[0] == "L" and len(codes.split()) > 1:  # ligatures
        return "".join(map(plain_string, (chr(int(c, 16)) for c in codes.split())))
    if tag == "<compat" and unicodedata.category(ch) == "Nl":  # numerals written as letters
        return "".join(chr(int(c, 16)) for c in codes.split())
    return unicodedata.normalize("NFD", ch)


class Classes:
    """Union-find over strings: code points, and the strings they read as."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, s: str) -> str:
        self.parent.setdefault(s, s)
        while self.parent[s] != s:
            self.parent[s] = self.parent[self.parent[s]]
            s = self.parent[s]
        return s

    def union(self, a: str, b: str) -> None:
        self.parent[self.find(a)] = self.find(b)


def rewrites(frequency: dict[str, int]) -> dict[str, str]:
    """Representative of every non-ASCII string to be rewritten, given the characters of the collection and how often each occurs.

    Looking alike is taken as transitive: the class of a character holds all that union-find reaches from it. A class
    with an ASCII member, of which there is one at most, is represented by it, so that texts of ASCII alone never
    change; any other by its most frequent member, the smallest string on ties.
    """
    classes = Classes()
    for plain, others in LOOKALIKES.items():
        for other in others:
            classes.union(other, plain)
    plain_of = {other: plain for plain, others in LOOKALIKES.items() for other in others}
    for ch in frequency:
        s = plain_string(ch)
        if s and s != ch:
            classes.union(ch, s)
        # A letter that looks like another also does so under an accent.
        t = "".join(plain_of.get(c, c) for c in s)
        if len(t) > 1 and t != s:
            classes.union(s, t)
    members: dict[str, list[str]] = {}
    for s in list(classes.parent):
        members.setdefault(classes.find(s), []).append(s)
    out = {ch: "" for ch in frequency if not plain_string(ch)}
    for same in members.values():
        plain = [s for s in same if s.isascii()]
        best = plain[0] if plain else min(same, key=lambda s: (-frequency.get(s, 0), s))
        out |= {s: best for s in same if s != best and not s.isascii()}
    return out


def automaton(table_: dict[str, str]) -> ahocorasick.Automaton | None:
    if not table_:
        return None
    a = ahocorasick.Automaton()
    for s, to in table_.items():
        a.add_word(s, (len(s), to))
    a.make_automaton()
    return a


def rewrite(text: str, a: ahocorasick.Automaton | None) -> str:
    """Replace from left to right the longest pattern at each place, then join accents to their letters; again while what was
    taken out or replaced lets other characters meet."""
    if a is None:
        return text
    for _ in range(len(text) + 1):
        before, apart = text, unicodedata.normalize("NFD", text)
        out, done = [], 0
        for end, (n, to) in a.iter_long(apart):
            out += (apart[done : end - n + 1], to)
            done = end + 1
        out.append(apart[done:])
        text = unicodedata.normalize("NFC", "".join(out))
        if text == before:
            break
    return text


# What precedes a port is a host, not a scheme.
_HOST = re.compile(r"(?s)^([A-Za-z][A-Za-z0-9+.-]*://|//|[A-Za-z][A-Za-z0-9+.-]*:(?![0-9]*(?:[/?#]|$)))?(?:[^/?#]*@)?([^/?#]*)")
_LABEL = re.compile(r"(?i)(?<![^.])xn--([^.:]+)")


def _decoded(m: re.Match) -> str:
    try:
        return m[1].encode("ascii").decode("punycode")
    except (UnicodeError, ValueError, OverflowError):
        return m[0]


def spelled_out(url: str) -> str:
    """``url`` with the ``xn--`` labels of its host as the text they stand for; labels that stand for none are left."""
    m = _HOST.match(url)
    return url[: m.start(2)] + _LABEL.sub(_decoded, m[2]) + url[m.end(2) :]


def plain_form(url: str, a: ahocorasick.Automaton | None) -> str:
    once = rewrite(url, a) if not url.isascii() else url
    if "xn--" not in once.lower():
        return once
    opened = spelled_out(once)
    return rewrite(opened, a) if opened != once else once


def character_counts(texts: DataFrame) -> dict[str, int]:
    """How often each non-ASCII character occurs in ``texts.text`` and in the host labels it hides; at most one entry per code point."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        total: Counter = Counter()
        for batch in batches:
            for t in batch.column("text").to_pylist():
                bare = "".join(c for c in unicodedata.normalize("NFKC", t) if not unseen(c))
                for s in {t, spelled_out(bare) if "xn--" in bare.lower() else t}:
                    total.update(c for c in s if c > "\x7f")
                    total.update(c for c in unicodedata.normalize("NFD", s) if c > "\x7f")
        yield pa.RecordBatch.from_arrays([pa.array([ord(c) for c in total], pa.int32()), pa.array(list(total.values()), pa.int64())], ["c", "n"])

    sums = texts.mapInArrow(count, "c int, n long").groupBy("c").agg(F.sum("n").alias("n"))
    return {chr(r.c): r.n for r in sums.collect()}


def with_plain_form(df: DataFrame, text: str, form: str) -> DataFrame:
    """``df`` with ``form``: the form under which texts of ``text`` that read the same are equal.

    Widths, accents apart or together, invisible characters, kinds of blank, look-alike letters and ``xn--`` host
    labels are brought together; ASCII characters stay as they are. Only rows with a non-ASCII character or such a
    label leave the JVM. Null stays null and the empty text empty; an empty table stays empty. A column that already has the
    name ``form`` is replaced.
    """
    odd = F.col(text).rlike(ODD)
    table_ = rewrites(character_counts(df.where(odd).select(F.col(text).alias("text"))))
    shared = df.sparkSession.sparkContext.broadcast(table_)

    @F.pandas_udf("string")
    def plain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = automaton(shared.value)
        for s in batches:
            yield s.map(lambda t: plain_form(t, a))

    changed = df.where(odd).withColumn(form, plain(F.col(text)))
    same = df.where(~odd | F.col(text).isNull()).withColumn(form, F.col(text))
    return changed.unionByName(same)


def lookalike_pairs(df: DataFrame, ident: str, text: str) -> DataFrame:
    """``(a, b)``, a < b, of rows whose ``text`` differs but reads the same.

    Texts of ASCII alone without ``xn--`` labels are their own form, hence never look like each other: one side of
    every pair is among the others. Pairs are first made of distinct texts, then of rows, so copies multiply only what
    is reported; forms with many texts and texts with many rows are dealt into blocks. Null texts and idents look like
    nothing; repeated rows give repeated pairs; an empty table gives none.
    """
    rows = df.select(F.col(ident).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    odd = rows.where(F.col("text").rlike(ODD)).select("text").distinct()
    odd = materialize(with_plain_form(odd, "text", "form"))
    sizes = odd.groupBy("form").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = pairs_within(odd.join(sizes, "form").select(F.col("form").alias("rep"), "n", F.col("text").alias("ident")))
    met = met.select(F.col("x").alias("s"), F.col("y").alias("t"))
    met = met.union(odd.where("text <> form").where(~F.col("form").rlike(ODD)).select("text", "form"))
    met = materialize(met)
    needed = met.select(F.col("s").alias("text")).union(met.select("t")).distinct()
    touched = materialize(rows.join(needed, "text", "left_semi"))
    sizes = touched.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    members = dealt(spread_join(touched, sizes.withColumn("w", F.col("n")), "text", weight="w", total=touched.count()).select(F.col("text").alias("rep"), "n", F.col("id").alias("ident")))
    both = meet(meet(met, "s", members, "x"), "t", members, "y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lookalike_pairs(table(spark, sf_dir, "prepared_urls"), "url_id", "url_model_input")
    return pairs.select(F.col("a").alias("url_id_a"), F.col("b").alias("url_id_b"))


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record whose text changes, its plain form, and whether its features say that it hides a label."""
    urls = with_plain_form(table(spark, sf_dir, "prepared_urls").select("url_id", "url_model_input"), "url_model_input", "plain_form")
    hints = table(spark, sf_dir, "url_features").groupBy("url_id").agg(F.max("has_punycode").alias("has_punycode"))
    return urls.where("plain_form <> url_model_input").join(hints, "url_id", "left").select("url_id", "plain_form", F.coalesce("has_punycode", F.lit(False)).alias("has_punycode"))


def _plain_sql(t: str) -> str:
    """Invisible characters taken out, blanks, wide forms and look-alike letters replaced, accents joined: the usual kinds of look-alike, in SQL."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    narrow = "".join(map(chr, range(0x21, 0x7F)))
    letters, plain = "".join(LOOKALIKES.values()), "".join(k * len(v) for k, v in LOOKALIKES.items())
    bare = rf"regexp_replace(regexp_replace({t}, '[\p{{Cf}}\x{{34f}}\x{{fe00}}-\x{{fe0f}}]', '', 'g'), '[\p{{Zs}}\p{{Zl}}\p{{Zp}}]', ' ', 'g')"
    quoted = (wide + letters, (narrow + plain).replace("'", "''"))
    return f"nfc_normalize(translate({bare}, '{quoted[0]}', '{quoted[1]}'))"


_T = "case when k <= bias then 1 when k >= bias + 26 then 26 else k - bias end"
_LENGTH = "(len(points) + 1)"
_DELTA = f"((i + digit * w - first) // (case when first = 0 then 700 else 2 end))"
#: CTEs ending in ``forms (t, form)``: distinct texts, with the hidden labels of their hosts decoded (RFC 3492) one digit in a step.
_FORMS = rf"""
texts as (select distinct url_model_input as t from prepared_urls where url_model_input is not null),
plain as (select t, case when regexp_matches(t, '[^\x00-\x7F]') then {_plain_sql('t')} else t end as p from texts),
cut as (select t, p, length(regexp_extract(p, '^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//)?(?:[^/?#]*@)?')) as before from plain where regexp_matches(p, '(?i)xn--')),
hosts as (select t, p, before, regexp_extract(substr(p, before + 1), '^[^/?#]*') as host from cut),
pieces as (select t, unnest(string_split(split_part(host, ':', 1), '.')) as label, unnest(range(len(string_split(split_part(host, ':', 1), '.')))) as nth from hosts),
hidden as (select distinct label, substr(label, 5) as code from pieces where regexp_matches(label, '^(?i:xn--)[\x00-\x7F]+$')),
parted as (select label, case when contains(code, '-') then regexp_extract(code, '^(.*)-', 1) else '' end as basic, lower(regexp_extract(code, '[^-]*$')) as ext from hidden),
steps as (
  select label, ext, 1 as pos, list_transform(string_split(basic, ''), lambda c: unicode(c)) as points, 128 as n, 0 as i, 72 as bias, 0 as first, 1 as w, 36 as k from parted where basic <> ''
  union all select label, ext, 1, []::int[], 128, 0, 72, 0, 1, 36 from parted where basic = ''
  union all select label, ext, pos + 1,
    case when done then list_concat(list_concat(points[1 : spot], [cast(n + turn // {_LENGTH} as int)]), points[spot + 1 :]) else points end,
    case when done then n + turn // {_LENGTH} else n end, case when done then spot + 1 else turn end,
    case when not done then bias when d0 <= 455 then 36 * d0 // (d0 + 38) when d0 // 35 <= 455 then 36 + 36 * (d0 // 35) // (d0 // 35 + 38) else 72 + 36 * (d0 // 1225) // (d0 // 1225 + 38) end,
    case when done then spot + 1 else first end, case when done then 1 else w * (36 - tt) end, case when done then 36 else k + 36 end
  from (select *, turn % {_LENGTH} as spot, delta + delta // {_LENGTH} as d0 from (select *, i + digit * w as turn, {_T} as tt, digit < {_T} as done, {_DELTA} as delta from
    (select *, case when substr(ext, pos, 1) between 'a' and 'z' then unicode(substr(ext, pos, 1)) - 97 else unicode(substr(ext, pos, 1)) - 22 end as digit from steps where pos <= length(ext))))
),
opened as (select label, array_to_string(list_transform(points, lambda x: chr(cast(x as int))), '') as text from steps where pos > length(ext) and k = 36),
joined as (select t, string_agg(coalesce(text, label), '.' order by nth) as host from pieces left join opened using (label) group by t),
spelled as (select h.t, substr(p, 1, before) || j.host || substr(p, before + 1 + length(split_part(h.host, ':', 1))) as u from hosts h join joined j using (t)),
forms as (select t, p as form from plain where not regexp_matches(p, '(?i)xn--') union all select t, {_plain_sql('u')} from spelled)
"""
ORACLE = {
    "p2_found": f"""with recursive {_FORMS} select x.url_id as url_id_a, y.url_id as url_id_b from forms f join prepared_urls x on x.url_model_input = f.t
      join forms g on g.form = f.form join prepared_urls y on y.url_model_input = g.t where x.url_id < y.url_id and f.t <> g.t""",
    "p2_forms": f"""with recursive {_FORMS}, hints as (select url_id, bool_or(has_punycode) as has_punycode from url_features group by 1)
      select p.url_id, f.form as plain_form, coalesce(h.has_punycode, false) as has_punycode from prepared_urls p join forms f on f.t = p.url_model_input left join hints h using (url_id) where f.form <> f.t""",
}
