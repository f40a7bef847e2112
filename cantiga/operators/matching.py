"""Raw names matched to the artist register."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantiga.sources.relation import Lookup, join_to_sums, joined_lookup, left_lookup

MATCH_KEYS = ("plataforma_origem", "chave_artista")
MATCH_COLUMNS = ("matched_artista_id", "matched_artista_keyword", "artista_casado")


def match_exact(keys: DataFrame) -> DataFrame:
    """(chave, id) pairs to one id per key: the smallest."""
    return keys.where(F.col("chave").isNotNull()).groupBy("chave").agg(F.min("id").alias("id"))


def array_keys(artists: DataFrame, column: str) -> DataFrame:
    """One (chave, id) row per element of an array column."""
    return artists.select(F.explode(column).alias("chave"), "id")


#: Characters of the pieces that names and keywords are compared by.
GRAM = 4


def name_pieces(names: DataFrame) -> DataFrame:
    """(nome, gram): the ``GRAM`` characters, or what is left, from each place of each distinct name on, each once."""
    cut = F.transform(F.sequence(F.lit(1), F.length("lower")), lambda at: F.substring("lower", at, F.lit(GRAM)))
    lowered = names.select("nome").where(F.col("nome").isNotNull()).distinct().withColumn("lower", F.lower("nome"))
    return lowered.where(F.length("lower") > 0).select("nome", F.explode(F.array_distinct(cut)).alias("gram"))


def anchored(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """(gram, word, best): each of the ``words`` by the one of its pieces that the fewest names have.

    A keyword shorter than a piece goes by every piece that begins with it.  One
    with a piece that no name has is in no name.
    """
    size = F.least(F.length("word"), F.lit(GRAM))
    own = F.transform(F.sequence(F.lit(1), F.length("word") - size + 1), lambda at: F.substring("word", at, size))
    keys = words.select("word", "best", F.explode(F.array_distinct(own)).alias("__key"))
    counted = pieces.groupBy("gram").agg(F.count("*").alias("__names"))
    beginnings = F.transform(F.sequence(F.lit(1), F.length("gram")), lambda n: F.substring("gram", F.lit(1), n))
    found = join_to_sums(keys, counted.select("gram", "__names", F.explode(beginnings).alias("key_0")), ["__key"])
    rarest = Window.partitionBy("word").orderBy(F.coalesce("__names", F.lit(0)), "gram")
    rated = found.withColumn("__rank", F.row_number().over(rarest)).where((F.col("__rank") == 1) | (F.length("word") < GRAM))
    return rated.where("__names > 0").select("gram", "word", "best")


def _by_keyword(names: DataFrame, words: DataFrame) -> DataFrame:
    """(nome, best): per name the row ``best`` of the longest of the ``words`` (word, best) it contains.

    A pattern join would compare every name with every keyword.  Instead a name
    meets only the keywords whose rarest piece it has, and is then searched for
    them.  Of a name there is a piece for each of its places, whatever lengths
    keywords have; keywords that share a piece travel in a few rows, so that a
    piece that most names have is a hot key on one side only, and is split.
    """
    pieces = name_pieces(names)
    word = F.struct((-F.length("word")).alias("minus_n"), "best", "word")
    # Keywords of one piece share a row where there are very many of them.
    dealt = anchored(words, pieces).groupBy(F.col("gram").alias("key_0"), F.pmod(F.xxhash64("word"), F.lit(1024)).alias("__row")).agg(F.collect_list(word).alias("__words"))
    found = join_to_sums(pieces, dealt, ["gram"], "inner")
    held = F.filter("__words", lambda w: F.contains(F.lower("nome"), w["word"]))
    longest = F.array_min(F.transform(held, lambda w: F.struct(w["minus_n"].alias("minus_n"), w["best"].alias("best"))))
    return found.select("nome", longest.alias("__longest")).where("__longest IS NOT NULL").groupBy("nome").agg(F.min("__longest").alias("__longest")).select("nome", F.col("__longest.best").alias("best"))


def _words(keywords: DataFrame, best: Column) -> DataFrame:
    """(word, best): the keywords in lower case, with the least row of each."""
    lowered = keywords.select(F.lower("keyword").alias("word"), best.alias("best")).where(F.length("word") > 0)
    return lowered.groupBy("word").agg(F.min("best").alias("best"))


def match_keyword(names: DataFrame, keywords: DataFrame) -> DataFrame:
    """Names that have a keyword anywhere in them, without regard to case.

    ``names``: (nome); ``keywords``: (id, keyword).  Of several keywords the
    longest wins, then the smallest id.  ``%`` and ``_`` stand for themselves.
    """
    return _by_keyword(names, _words(keywords, F.struct("id"))).select("nome", "best.id")


def _by_composer(tracks: DataFrame, composers: DataFrame) -> DataFrame:
    """(codigo_musica, best) of tracks whose composer is among ``composers`` (chave, best); one row per track code."""
    found = join_to_sums(
        tracks.select("codigo_musica", F.col("compositor").alias("__composer")), composers.withColumnRenamed("chave", "key_0"), ["__composer"], "inner"
    )
    return found.groupBy("codigo_musica").agg(F.min("best").alias("best"))


def match_composer(tracks: DataFrame, artists: DataFrame) -> DataFrame:
    """(codigo_musica, id): the track's composer equals the registered one; of a code listed more than once the smallest id."""
    composers = match_exact(artists.select(F.col("universal_compositor").alias("chave"), "id"))
    return _by_composer(tracks, composers.select("chave", F.struct("id").alias("best"))).select("codigo_musica", "best.id")


def artist_matches(artists: DataFrame, orchard_names: DataFrame, tracks: DataFrame) -> DataFrame:
    """Every (platform, key) that resolves to a registered artist, one row each.

    The register is spread into its keys once; each key takes the register's
    columns along, so that nothing is joined back to it.
    """
    best = F.struct("id", F.col("nome_artistico").alias("name"), F.col("artista_keyword").alias("keyword"))
    text = lambda column: F.array(F.col(column).cast("string"))
    kinds = {
        "DSU": text("dsu_artista"),
        "Warner Chappell": F.col("warner_chappel_deal_scope_name").cast("array<string>"),
        "Warner Music": text("warner_music_artist_name"),
    }
    keys = F.concat(*[F.transform(F.coalesce(values, F.array()), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("chave"))) for kind, values in kinds.items()])
    spread = artists.select(best.alias("best"), F.explode(keys).alias("key")).select("key.kind", "key.chave", "best").where(F.col("chave").isNotNull())
    exact = spread.groupBy(F.col("kind").alias("plataforma_origem"), F.col("chave").alias("chave_artista")).agg(F.min("best").alias("best"))
    composers = artists.select(F.col("universal_compositor").alias("chave"), best.alias("best")).where(F.col("chave").isNotNull()).groupBy("chave").agg(F.min("best").alias("best"))
    keywords = _words(artists.withColumn("keyword", F.col("artista_keyword")), best)
    by_keyword = _by_keyword(orchard_names, keywords).select(F.lit("Orchard").alias("plataforma_origem"), F.col("nome").alias("chave_artista"), "best")
    by_composer = _by_composer(tracks, composers).select(F.lit("Universal").alias("plataforma_origem"), F.col("codigo_musica").alias("chave_artista"), "best")
    return exact.unionByName(by_keyword).unionByName(by_composer).select(
        "plataforma_origem",
        "chave_artista",
        F.col("best.id").alias("matched_artista_id"),
        F.when(F.col("plataforma_origem") == "Orchard", F.col("best.keyword")).alias("matched_artista_keyword"),
        F.col("best.name").alias("artista_casado"),
    )


def artist_lookup(matches, raw: str = "artista_raw", name: str = "artista") -> Lookup:
    """Lookup of the match columns and of the name to show: matched, else raw."""
    plain = left_lookup(MATCH_KEYS, MATCH_COLUMNS, matches).found

    def settle(frame: DataFrame) -> DataFrame:
        return plain.settle(frame).withColumn(name, F.coalesce("artista_casado", raw))

    return joined_lookup(replace(plain, settle=settle), (*MATCH_COLUMNS, name), (*MATCH_KEYS, raw))
