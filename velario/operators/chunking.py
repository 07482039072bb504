"""Sentences, token counts and packing of sentences into chunks.

Packing is a fold with a reset and needs the whole document, which is one row. ``pack_rows`` is the same fold outside the JVM, which
tests compare it with.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from velario.functions.text import MATCH, UNICODE, find_all, let

SENTENCE = "struct<text:string,start:int,end:int>"
CHUNK = f"struct<index:int,total:int,char_start:int,char_end:int,token_count:int,sentences:array<{SENTENCE}>>"
#: Abbreviations after which a sentence goes on (fixed values).
ABBREVIATIONS = "Sr|Sra|Srta|Dr|Dra|Lic|Ing|Prof|Av|Bv|art|arts|inc|fs|pág|págs|p|pp|ob|cit|conf|cfr|Cám|Civ|Com|Nro|núm|EE|UU|vs|etc|ej|S\\.A|S\\.R\\.L|D\\.N\\.I|L\\.E|L\\.C"
#: The word before a mark is looked at after the mark is found, not at every place of the text.
BOUNDARY = UNICODE + rf"[.!?…](?<!\b(?:{ABBREVIATIONS}|[A-ZÁÉÍÓÚÑ])[.!?…])[.!?…]*[\"»”')\]]*\s+(?=[\"«“'(\[¿¡—-]*[A-ZÁÉÍÓÚÑ0-9])|\n\s*\n\s*"


def sentences(text: Column) -> Column:
    """Sentences with exact offsets, none blank: text[start:end] is the sentence, blanks at its end included as in the text."""

    def in_text(t: Column) -> Column:
        marks = F.array_append(F.regexp_extract_all(t, F.lit(BOUNDARY), F.lit(0)), "")
        return let(F.zip_with(F.split(t, BOUNDARY, -1), marks, lambda part, mark: F.concat(part, mark)), placed)

    def placed(parts: Column) -> Column:
        def step(acc: Column, p: Column) -> Column:
            return F.array_append(acc, F.struct(p.alias("text"), F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)).alias("start"), (F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)) + F.length(p)).alias("end")))

        return F.filter(F.aggregate(parts, none, step), lambda s: s["text"].rlike(r"(?U)\S"))

    none = F.expr(f"cast(array() as array<{SENTENCE}>)")
    return F.when(text.isNull(), none).otherwise(let(text, in_text))


def tokens(text: Column) -> Column:
    """Four characters to a token; none if empty or null."""
    n = F.coalesce(F.length(text), F.lit(0))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor((n + 3) / 4)).cast("int"))


def split_oversized(s: Column, most: int, count: Callable[[Column], Column] = tokens) -> Column:
    """Parts of a sentence over the limit: at ; else : else , if then all parts fit; else greedily by words."""
    text = s["text"]

    def at(mark: str) -> Column:
        parts = find_all(text, rf"[^{mark}]*{mark}|[^{mark}]+$")
        made = F.transform(parts, lambda m: F.struct(m["text"].alias("text"), (s["start"] + m["start"]).alias("start"), (s["start"] + m["end"]).alias("end")))
        return F.filter(made, lambda p: F.trim(p["text"]) != "")

    empty = F.struct(F.lit("").alias("buf"), F.lit(0).alias("at"), F.lit(0).alias("pos"), F.lit(False).alias("any"), F.expr(f"cast(array() as array<{SENTENCE}>)").alias("out"))

    def word(acc: Column, w: Column) -> Column:
        longer = F.when(acc["any"], F.concat(acc["buf"], F.lit(" "), w)).otherwise(w)
        full = acc["any"] & (count(longer) > most)
        piece = F.struct(acc["buf"].alias("text"), (s["start"] + acc["at"]).alias("start"), (s["start"] + acc["at"] + F.length(acc["buf"])).alias("end"))
        return F.struct(
            F.when(full, w).otherwise(longer).alias("buf"), F.when(full, acc["pos"]).otherwise(acc["at"]).alias("at"), (acc["pos"] + F.length(w) + 1).alias("pos"), F.lit(True).alias("any"),
            F.when(full, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"),
        )

    def rest(acc: Column) -> Column:
        return F.concat(acc["out"], F.array(F.struct(acc["buf"].alias("text"), (s["start"] + acc["at"]).alias("start"), s["end"].alias("end"))))

    out = F.aggregate(F.split(text, " "), empty, word, rest)
    for mark in (",", ":", ";"):
        parts = at(mark)
        out = F.when(F.contains(text, F.lit(mark)) & F.forall(parts, lambda p: count(p["text"]) <= most), parts).otherwise(out)
    return F.when(count(text) <= most, F.array(s)).otherwise(out)


def pack(sents: Column, most: int, overlap: int = 0, count: Callable[[Column], Column] = tokens) -> Column:
    """array<chunk>: sentences packed in order up to ``most`` tokens; the last ``overlap`` sentences are carried over."""
    if most <= 0 or overlap < 0:
        raise ValueError("the limit must be positive and the overlap not negative")
    fitted = F.flatten(F.transform(sents, lambda s: split_oversized(s, most, count)))
    empty = F.expr(f"cast(array() as array<{SENTENCE}>)")
    zero = F.struct(empty.alias("buf"), F.lit(0).alias("n"), F.expr(f"cast(array() as array<struct<n:int,sents:array<{SENTENCE}>>>)").alias("out"))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + count(x["text"]).cast("int"))

    def step(acc: Column, s: Column) -> Column:
        t = count(s["text"]).cast("int")
        full = (F.size(acc["buf"]) > 0) & (acc["n"] + t > most)
        done = F.concat(acc["out"], F.array(F.struct(acc["n"].alias("n"), acc["buf"].alias("sents"))))
        carry = F.slice(acc["buf"], F.greatest(F.size(acc["buf"]) - overlap + 1, F.lit(1)), F.lit(overlap)) if overlap else empty
        kept = total(carry) if overlap else F.lit(0)
        return F.struct(
            F.when(full, F.concat(carry, F.array(s))).otherwise(F.concat(acc["buf"], F.array(s))).alias("buf"),
            F.when(full, kept + t).otherwise(acc["n"] + t).alias("n"),
            F.when(full, done).otherwise(acc["out"]).alias("out"),
        )

    def close(acc: Column) -> Column:
        return F.when(F.size(acc["buf"]) > 0, F.concat(acc["out"], F.array(F.struct(acc["n"].alias("n"), acc["buf"].alias("sents"))))).otherwise(acc["out"])

    packed = F.aggregate(fitted, zero, step, close)
    return F.transform(
        packed,
        lambda c, i: F.struct(
            (i + 1).alias("index"), F.size(packed).alias("total"), F.element_at(c["sents"], 1)["start"].alias("char_start"), F.element_at(c["sents"], -1)["end"].alias("char_end"), c["n"].alias("token_count"),
            c["sents"].alias("sentences"),
        ),
    )


def chunk_text(text: Column, chunk: Column) -> Column:
    """The exact text of a chunk, blanks between its sentences included."""
    return F.substring(text, chunk["char_start"] + 1, chunk["char_end"] - chunk["char_start"])


def pack_rows(sents: list[tuple[str, int, int]], most: int, overlap: int = 0) -> list[tuple[int, int, int, int]]:
    """(index, char_start, char_end, token_count) of the chunks of a list of sentences; the same packing outside the JVM."""
    count = lambda t: 0 if not t else max(1, (len(t) + 3) // 4)
    fitted: list[tuple[str, int, int]] = []
    for t, a, b in sents:
        if count(t) <= most:
            fitted.append((t, a, b))
            continue
        for mark in ";:,":
            parts = [(m.group(), a + m.start(), a + m.end()) for m in re.finditer(rf"[^{mark}]*{mark}|[^{mark}]+$", t) if m.group().strip()]
            if mark in t and all(count(p[0]) <= most for p in parts):
                fitted += parts
                break
        else:
            buf, at, pos = "", 0, 0
            for k, w in enumerate(t.split(" ")):
                longer = f"{buf} {w}" if k and buf is not None and pos > at else w
                if pos > at and count(longer) > most:
                    fitted.append((buf, a + at, a + at + len(buf)))
                    buf, at = w, pos
                else:
                    buf = longer
                pos += len(w) + 1
            fitted.append((buf, a + at, b))
    out, buf, n = [], [], 0
    for s in fitted:
        t = count(s[0])
        if buf and n + t > most:
            out.append((len(out) + 1, buf[0][1], buf[-1][2], n))
            buf = buf[-overlap:] if overlap else []
            n = sum(count(x[0]) for x in buf)
        buf.append(s)
        n += t
    if buf:
        out.append((len(out) + 1, buf[0][1], buf[-1][2], n))
    return out


__all__ = ["MATCH", "sentences", "tokens", "split_oversized", "pack", "chunk_text", "pack_rows"]
