"""Line-first cleaning: rules judge each line, failing lines go, then texts that lost too much go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stainloom.llm.common import SPACE, text_of, words_of

#: Phrases of page furniture in four languages, as words in lower case. Fixed values.
BOILERPLATE = [
    "accept all cookies", "accept cookies", "add to cart", "all rights reserved", "back to top", "click here", "contact us", "cookie policy", "cookie settings",
    "enable javascript", "follow us on", "forgot your password", "javascript is disabled", "leave a comment", "log in", "lorem ipsum", "privacy policy", "read more",
    "share this", "sign in", "sign up", "skip to content", "skip to main content", "subscribe to our newsletter", "terms and conditions", "terms of service", "terms of use", "use cookies",
    "alle cookies akzeptieren", "alle rechte vorbehalten", "allgemeine geschäftsbedingungen", "cookies akzeptieren", "datenschutzerklärung", "hier klicken", "in den warenkorb",
    "jetzt anmelden", "mehr erfahren", "nach oben", "newsletter abonnieren", "nutzungsbedingungen", "passwort vergessen", "weiterlesen", "zum inhalt springen",
    "abonnez vous à notre newsletter", "accepter les cookies", "ajouter au panier", "aller au contenu", "cliquez ici", "conditions d utilisation", "en savoir plus", "haut de page",
    "lire la suite", "mentions légales", "mot de passe oublié", "politique de confidentialité", "se connecter", "tous droits réservés",
    "aceptar cookies", "aceptar todas las cookies", "aviso legal", "añadir al carrito", "haga clic aquí", "iniciar sesión", "ir al contenido", "leer más", "olvidó su contraseña",
    "política de cookies", "política de privacidad", "suscríbete a nuestro boletín", "todos los derechos reservados", "términos y condiciones", "volver arriba",
]
_GAP, _PART = "[^\\p{L}\\p{N}]+", "[\\p{L}\\p{N}]"
FURNITURE = f"(?<!{_PART})(?:{'|'.join(x.replace(' ', _GAP) for x in BOILERPLATE)})(?!{_PART})"
#: Words of a line at most that a phrase of page furniture speaks for.
FURNITURE_WORDS = 40
#: Words after the last end of a sentence with which a line is still a sentence's.
OPEN_WORDS = 9
#: The end of a line that ends a sentence: a mark, closing quotes or brackets after it, and some words at most.
SENTENCE_END = f"[.!?…:;。！？][\"'”’»“)\\]]*(?:[{SPACE}]+[^{SPACE}]+){{0,{OPEN_WORDS}}}[{SPACE}]*$"
SYMBOLS = "[#*$%&|<>]"
MARKS = "[#*$%&|<>»•]"
LINE_SYMBOLS = 0.2
LOST_SHARE = 50


def line_reason(line: Column, following: Column, phrases: Column, symbols: Column) -> Column:
    """Why a line fails, or null; ``phrases`` tells whether its text has any phrase of page furniture, ``symbols`` any symbol.

    navigation: three separators (``|``, ``>``, ``»``, ``•``) or more, at least one in three words;
    boilerplate: a phrase of page furniture, as whole words, in a line of 40 words or fewer;
    symbols: more than one in five words with a symbol of mark-up; punctuation: a line whose last
    10 words or more end no sentence, unless the line ``following`` it begins with a lower-case
    letter and so continues it. Lines without words pass.
    """
    n = F.regexp_count(line, F.lit(f"[^{SPACE}]+"))
    bars = F.regexp_count(line, F.lit("[|>»•]"))
    # A word is entered at its start only, so that the search is linear in very long words too.
    marks = F.regexp_count(line, F.lit(f"(?<![^{SPACE}])[^{SPACE}#*$%&|<>]*+{SYMBOLS}[^{SPACE}]*+"))
    some = symbols & line.rlike(MARKS)
    ends = line.endswith(".") | line.rlike(SENTENCE_END) | F.coalesce(following.rlike(f"^[{SPACE}]*\\p{{Ll}}"), F.lit(False))
    return (
        F.when(some & (bars >= 3) & (bars * 3 >= n), "navigation")
        .when(phrases & F.lower(line).rlike(FURNITURE) & (n <= FURNITURE_WORDS), "boilerplate")
        .when(some & (marks > n * LINE_SYMBOLS), "symbols")
        .when(~ends & (n > OPEN_WORDS), "punctuation")
    )


def _windows(words: Column) -> Column:
    """A hash of each 3-word window, by its first word."""
    n = F.size(words)
    three = F.arrays_zip(words.alias("a"), F.slice(words, 2, n).alias("b"), F.slice(words, 3, n).alias("c"))
    return F.transform(F.slice(three, 1, F.greatest(n - 2, F.lit(0))), lambda x: F.xxhash64(x))


def fenced(c: Column) -> Column:
    """The same value, which the optimizer will not put in place of its name.

    A later filter or a pruned column can leave one use of an array inside a lambda. Put in place
    there, it would be made anew for each element.
    """
    return F.when(F.spark_partition_id() >= 0, c)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """Judges every whole text; one row for each row of docs, none of them merged.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_lines_removed, words_removed and clean_text. A null or blank text has no words and fails;
    repeated rows and ids are judged each for itself; other columns are ignored whatever their
    names, but those in ``extra`` are returned as well. Base: fewer than 50 words, or over half of the words in repeated windows. After that a
    document stays unless its failing lines hold more than half of its words.

    Built-in functions only, within one row: no shuffle, and memory for one text at a time.
    Windows are compared by 64-bit hash, sorted with their places, in n log n steps.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_t"), *extra)
    d = d.select(*extra, "doc_id", "_t", fenced(words_of(F.col("_t"))).alias("_w"), fenced(F.split("_t", "\n", -1)).alias("_l"))
    d = d.select(
        *extra, "doc_id", "_t", "_w", "_l", fenced(F.lower("_t").rlike(FURNITURE)).alias("_furniture"), fenced(F.col("_t").rlike(MARKS)).alias("_marked"), F.size("_w").cast("long").alias("n_words"),
        F.filter("_l", lambda x: x.rlike(f"[^{SPACE}]")).alias("_full"), fenced(_windows(F.col("_w"))).alias("_h"),
    )
    d = d.withColumn("_some", F.size(F.array_distinct("_h")) < F.size("_h"))
    # Windows by hash, then those with an equal neighbour, by place.
    d = d.withColumn("_s", fenced(F.when(F.col("_some"), F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))))
    like = lambda x, i: F.coalesce(F.get("_s", i)["h"] == x["h"], F.lit(False))
    at = F.transform("_s", lambda x, i: F.when((i > 0) & like(x, i - 1) | like(x, i + 1), x["i"]))
    d = d.withColumn("_p", fenced(F.when(F.col("_some"), F.array_sort(F.array_compact(at)))))
    reach = F.transform("_p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - x, F.lit(3))))
    d = d.withColumn("n_repeat_words", F.when(F.col("_some"), F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long")))
    d = d.withColumn("_j", fenced(F.transform("_l", lambda x, i: F.struct(x.alias("x"), line_reason(x, F.get("_l", i + 1), F.col("_furniture"), F.col("_marked")).alias("why")))))
    line = lambda j: j["x"]
    bad = F.transform(F.filter("_j", lambda j: j["why"].isNotNull()), line)
    good = F.transform(F.filter("_j", lambda j: j["why"].isNull()), line)
    d = d.withColumns({"_bad": bad, "clean_text": F.array_join(good, "\n")})
    lost = F.aggregate("_bad", F.lit(0).cast("long"), lambda a, x: a + F.regexp_count(x, F.lit(f"[^{SPACE}]+")))
    d = d.withColumn("words_removed", lost)
    d = d.select(
        *extra, "doc_id", "n_words", F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.size("_bad").cast("long").alias("n_lines_removed"), "words_removed", "clean_text",
    )
    return d.withColumn("kept", fenced(~F.col("base_failed") & (100 * F.col("words_removed") <= LOST_SHARE * F.col("n_words"))))
