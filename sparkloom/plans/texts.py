"""Text analytics over the whole documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import textfn
from sparkloom.operators import aggregate, joins, select, setops, text
from sparkloom.plans.registry import Tables, query
from sparkloom.runtime import cut_lineage, materialise

# Stop words removed before classification and weighting.
STOP = ("the of and to in is it on that for with as at this be are by an der die das und ist "
        "le la les de des et un une el los las y que en").split()
_STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOP) + ")"
_W = r"[\p{L}\p{N}]+"

TOK_SQL = rf"""tok AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '{_W}')) AS term FROM documents),
dt AS (SELECT doc_id, lang, term, count(*) AS count FROM tok GROUP BY ALL)
"""
SPLIT_SQL = """, split AS (SELECT doc_id, lang, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < 0.75 AS training FROM documents)
"""


def _sql(s: str) -> str:
    return s.replace("'", "''")


@query("WITH " + TOK_SQL + "SELECT doc_id, term, count FROM dt")
def doc_term_counts(t: Tables) -> DataFrame:
    return text.doc_terms(t.docs, "doc_id", "text")


KMER_SQL = rf"""ws AS (SELECT regexp_extract_all(lower(line), '{_W}') AS w FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)),
km AS (SELECT array_to_string(w[i:i + 2], ' ') AS kmer FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM ws WHERE len(w) >= 3))
"""


@query("WITH " + KMER_SQL + "SELECT kmer, count(*) AS n FROM km GROUP BY kmer")
def count_kmers(t: Tables) -> DataFrame:
    return text.count_kmers(t.docs, "text", 3)


@query("WITH " + KMER_SQL + "SELECT kmer, count(*) AS n FROM km GROUP BY kmer ORDER BY n DESC, kmer LIMIT 10")
def top_kmers(t: Tables) -> DataFrame:
    return text.top_kmers(t.docs, "text", 3, 10)


# The alternatives of the tokenizer written out for the SQL side, in order: phone number, address, emoticon either
# way round, tag, user, hashtag, dashed word, number, word, dots, anything else that is seen.
_SOCIAL_SQL = (
    r"(?i)(?:(?:\+?[01][\-\s.]*)?(?:[\(]?\d{3}[\-\s.\)]*)?\d{3}[\-\s.]*\d{4})"
    r"|http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\(\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
    r"|(?:[<>]?[:;=8][\-o\*\']?[\)\]\(\[dDpP/\:\}\{@\|\\]|[\)\]\(\[dDpP/\:\}\{@\|\\][\-o\*\']?[:;=8][<>]?)"
    r"|<[^>]+>|(?:@[\p{L}\p{N}_]+)|(?:#+[\p{L}\p{N}_]+[\p{L}\p{N}_\'\-]*[\p{L}\p{N}_]+)|(?:[a-z][a-z'\-_]+[a-z])"
    r"|(?:[+\-]?\d+[,/.:-]\d+[+\-]?)|(?:[\p{L}\p{N}_]+)|(?:\.(?:\s*\.)+)|(?:[^\s\p{Z}])")


def _token_sql(source: str) -> str:
    return (rf"list_transform(regexp_extract_all({source}, '{_sql(_SOCIAL_SQL)}'), lambda w: "
            rf"CASE WHEN regexp_matches(w, '(?i)http[s]?://([a-z0-9$-_@.&+!*(),]|%[0-9a-f][0-9a-f])') THEN w ELSE lower(w) END)")


# Named references of the Latin-1 block and of markup; &amp; becomes a word.
_NAMES = {"quot": 34, "lt": 60, "gt": 62, "nbsp": 160, "iexcl": 161, "cent": 162, "pound": 163, "yen": 165, "sect": 167, "copy": 169, "laquo": 171,
          "reg": 174, "deg": 176, "plusmn": 177, "middot": 183, "raquo": 187, "iquest": 191, "Agrave": 192, "Eacute": 201, "agrave": 224, "aacute": 225,
          "acirc": 226, "auml": 228, "ccedil": 231, "egrave": 232, "eacute": 233, "ecirc": 234, "iacute": 237, "icirc": 238, "ntilde": 241,
          "oacute": 243, "ocirc": 244, "ouml": 246, "uacute": 250, "ucirc": 251, "uuml": 252, "szlig": 223, "ndash": 8211, "mdash": 8212, "hellip": 8230, "euro": 8364}


def _unescaped(source: str) -> str:
    for name, code in _NAMES.items():
        source = f"replace({source}, '&{name};', chr({code}))"
    return f"replace({source}, '&amp;', ' and ')"


_ENT = _unescaped("html")
_DOC_ENT = _unescaped("text")


@query(f"SELECT doc_id, len(w) AS n_tokens, md5(array_to_string(w, chr(10))) AS digest FROM (SELECT doc_id, {_token_sql(_DOC_ENT)} AS w FROM documents)")
def tokenize_documents(t: Tables) -> DataFrame:
    w = t.docs.select("doc_id", textfn.tokenize_social(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("bigint").alias("n_tokens"), F.md5(F.array_join("w", "\n")).alias("digest"))


@query(f"SELECT page_id, len(w) AS n_tokens, md5(array_to_string(w, chr(10))) AS digest FROM (SELECT page_id, {_token_sql(_ENT)} AS w FROM pages)")
def tokenize_pages(t: Tables) -> DataFrame:
    w = t.pages.select("page_id", textfn.tokenize_social(F.col("html")).alias("w"))
    return w.select("page_id", F.size("w").cast("bigint").alias("n_tokens"), F.md5(F.array_join("w", "\n")).alias("digest"))


_GROUP_SQL = "CASE WHEN replace(source, 'src', '')::INTEGER < 14 THEN replace(source, 'src', '')::INTEGER % 7 ELSE 7 END"
_PAIRS_SQL = f"pairs AS (SELECT DISTINCT source, {_GROUP_SQL} AS grp, unnest({_token_sql(_DOC_ENT)}) AS token FROM documents)"


def user_groups(t: Tables) -> DataFrame:
    """Group 0..6 of the known users."""
    return group_of(t.documents.select("source").distinct())


def group_of(users: DataFrame) -> DataFrame:
    number = F.regexp_replace("source", "src", "").cast("int")
    return users.withColumn("grp", number % 7).filter(number < 14)


@query(f"SELECT grp, count(*) AS n_posts, count(DISTINCT source) AS n_users FROM (SELECT source, {_GROUP_SQL} AS grp FROM documents) GROUP BY grp")
def posts_by_group(t: Tables) -> DataFrame:
    """Users missing from the lookup fall into group 7."""
    posts = materialise(t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "posts")  # one row per user
    mapping = group_of(posts.select("source")).withColumnRenamed("source", "user")
    tagged = joins.lookup_default(posts, mapping, "source", "user", "grp", 7)
    return tagged.groupBy("grp").agg(F.sum("n").alias("n_posts"), F.count("source").alias("n_users"))


@query("WITH " + _PAIRS_SQL + " SELECT token, count(*) AS n_users FROM pairs GROUP BY token HAVING count(*) >= 5")
def mentions_per_token(t: Tables) -> DataFrame:
    return text.mentions_per_token(t.docs, "source", "text", 5)


@query("WITH " + _PAIRS_SQL + """, g AS (SELECT token, grp, count(*) AS n_group FROM pairs GROUP BY ALL),
a AS (SELECT token, sum(n_group)::BIGINT AS n_all FROM g GROUP BY token HAVING sum(n_group) >= 5),
s AS (SELECT grp, token, n_group, n_all, log2(n_group / n_all) AS p FROM g JOIN a USING (token))
SELECT grp, token, n_group, n_all, round(p, 6) AS popularity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p DESC, token)::INTEGER AS rank FROM s) WHERE rank <= 10""")
def relative_popularity(t: Tables) -> DataFrame:
    out = text.relative_popularity(t.docs.select("source", "text"), "source", materialise(user_groups(t), "groups"), "grp", 7, "text", 5, 10)
    return out.withColumn("popularity", F.round("popularity", 6) + 0.0)


CTX_SQL = TOK_SQL + r""", pos AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM
  (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)),
v AS (SELECT term FROM dt GROUP BY term ORDER BY sum(count) DESC, term LIMIT 5000),
c AS (SELECT term FROM dt GROUP BY term ORDER BY sum(count) DESC, term LIMIT 1000),
cc AS (SELECT a.word, b.word AS context, count(DISTINCT (a.doc_id, a.p)) AS n
  FROM (SELECT *, unnest([-2, -1, 1, 2]) AS d FROM pos WHERE word IN (SELECT term FROM v)) a
  JOIN pos b ON a.doc_id = b.doc_id AND b.p = a.p + a.d WHERE b.word IN (SELECT term FROM c) GROUP BY ALL)
"""


VOCABULARY, CONTEXTS = 5000, 1000


def _contexts(t: Tables) -> DataFrame:
    tokens = text.token_lists(t.docs, "text")
    top = cut_lineage(text.most_common_words(tokens, VOCABULARY))
    return text.context_counts(tokens, top, top.orderBy(F.desc("count"), "term").limit(CONTEXTS))


@query("WITH " + CTX_SQL + "SELECT * FROM cc")
def context_counts(t: Tables) -> DataFrame:
    return _contexts(t)


@query("WITH " + CTX_SQL + """, r AS (SELECT word, sum(n) AS rn FROM cc GROUP BY 1), k AS (SELECT context, sum(n) AS cn FROM cc GROUP BY 1)
SELECT word, context, n, round(greatest(0.0, log10((n / rn) / (cn / (SELECT sum(n) FROM cc)))), 6) AS ppmi
FROM cc JOIN r USING (word) JOIN k USING (context)""")
def ppmi(t: Tables) -> DataFrame:
    return text.ppmi(_contexts(t)).withColumn("ppmi", F.round("ppmi", 6))


@query("WITH " + TOK_SQL + f""", kept AS (SELECT * FROM dt WHERE term NOT IN {_STOP_SQL}),
ids AS (SELECT term, row_number() OVER (ORDER BY term) AS word_id FROM (SELECT DISTINCT term FROM kept))
SELECT doc_id, term, count, word_id FROM kept JOIN ids USING (term)""")
def remove_stopwords(t: Tables) -> DataFrame:
    return text.remove_stopwords(materialise(text.doc_terms(t.docs, "doc_id", "text"), "terms"), STOP)


@query("WITH " + TOK_SQL + f""", kept AS (SELECT * FROM dt WHERE term NOT IN {_STOP_SQL}),
f AS (SELECT term, sum(count) AS c, count(*) AS df FROM kept GROUP BY term ORDER BY c DESC, term LIMIT 300),
w AS (SELECT doc_id, term, count * (ln((1 + (SELECT count(DISTINCT doc_id) FROM dt)) / (1 + df)) + 1) AS w FROM kept JOIN f USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM w""")
def tfidf(t: Tables) -> DataFrame:
    out = text.tfidf(materialise(text.doc_terms(t.docs, "doc_id", "text"), "terms"), "doc_id", 300, STOP)
    return out.withColumn("tfidf", F.round("tfidf", 6))


def _nb_parts(t: Tables):
    terms = materialise(text.doc_terms(t.docs, "doc_id", "text", ["lang"]), "terms")
    inside = select.hash_share(F.col("doc_id")) < 0.75
    train = terms.filter(inside)
    return train, terms.filter(~inside).drop("lang"), t.docs.filter(inside).select("doc_id", "lang")


NB_SQL = "WITH " + TOK_SQL + SPLIT_SQL + """, train AS (SELECT dt.* FROM dt JOIN split USING (doc_id) WHERE training),
test AS (SELECT dt.* FROM dt JOIN split USING (doc_id) WHERE NOT training), vocab AS (SELECT DISTINCT term FROM train),
prior AS (SELECT lang, count(*) AS nd, ln(count(*) / (SELECT count(*) FROM split WHERE training)) AS lp FROM split WHERE training GROUP BY lang)
"""
_BEST = "SELECT doc_id, lang AS predicted, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang DESC) AS rn FROM sc) WHERE rn = 1"


@query(NB_SQL + """, wc AS (SELECT lang, term, coalesce(n, 0) AS n FROM (SELECT lang, term FROM prior, vocab)
  LEFT JOIN (SELECT lang, term, sum(count) AS n FROM train GROUP BY ALL) USING (lang, term)),
ll AS (SELECT lang, term, ln((n + 1) / (sum(n) OVER (PARTITION BY lang) + (SELECT count(*) FROM vocab))) AS l FROM wc),
ev AS (SELECT doc_id, ll.lang, sum(count * l) AS s FROM test JOIN ll USING (term) GROUP BY ALL),
sc AS (SELECT d.doc_id, p.lang, lp + coalesce(s, 0) AS score FROM (SELECT DISTINCT doc_id FROM test) d CROSS JOIN prior p
  LEFT JOIN ev ON ev.doc_id = d.doc_id AND ev.lang = p.lang)
""" + _BEST)
def multinomial_nb(t: Tables) -> DataFrame:
    train, test, docs = _nb_parts(t)
    return text.multinomial_nb(train, test, docs, "doc_id", "lang").withColumn("score", F.round("score", 4))


@query(NB_SQL + """, wc AS (SELECT p.lang, term, coalesce(n, 0) AS n, nd FROM (SELECT lang, nd, term FROM prior, vocab) p
  LEFT JOIN (SELECT lang, term, count(*) AS n FROM train GROUP BY ALL) x USING (lang, term)),
ll AS (SELECT lang, term, ln((n + 1) / (nd + 2)) AS yes, ln(1 - (n + 1) / (nd + 2)) AS no FROM wc),
base AS (SELECT lang, sum(no) AS b FROM ll GROUP BY lang),
ev AS (SELECT doc_id, ll.lang, sum(yes - no) AS s FROM test JOIN ll USING (term) GROUP BY ALL),
sc AS (SELECT d.doc_id, p.lang, lp + b + coalesce(s, 0) AS score FROM (SELECT DISTINCT doc_id FROM test) d CROSS JOIN prior p JOIN base USING (lang)
  LEFT JOIN ev ON ev.doc_id = d.doc_id AND ev.lang = p.lang)
""" + _BEST)
def bernoulli_nb(t: Tables) -> DataFrame:
    train, test, docs = _nb_parts(t)
    return text.bernoulli_nb(train, test, docs, "doc_id", "lang").withColumn("score", F.round("score", 4))


_P = r"[!-/:-@\[-`{-~]"


@query(rf"""WITH a AS (SELECT doc_id, text, regexp_extract_all(regexp_replace(text, '{_P}', '', 'g'), '[^\s]+') AS w,
  list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_matches(s, '\S')) AS s FROM documents)
SELECT doc_id, len(w)::INTEGER AS n_words, len(s)::INTEGER AS n_sentences,
 round(CASE WHEN len(w) = 0 THEN 0 ELSE len(list_filter(w, lambda x: regexp_matches(x, '^\p{{Lu}}{{2,}}$'))) / len(w) END, 6) AS caps_word_share,
 round(CASE WHEN len(s) = 0 THEN 0 ELSE len(list_filter(s, lambda x: x = upper(x) AND regexp_replace(x, '{_P}|\s', '', 'g') <> '')) / len(s) END, 6) AS caps_sentence_share,
 round(coalesce(len(regexp_extract_all(text, '[A-Z]')) / nullif(len(regexp_extract_all(text, '[A-Za-z]')), 0), 0), 6) AS capital_share,
 round(coalesce(len(regexp_extract_all(text, '{_P}')) / nullif(length(text), 0), 0), 6) AS punctuation_share FROM a""")
def text_shape(t: Tables) -> DataFrame:
    cols = textfn.text_shape(F.col("text"), F.col("tokens"), F.col("sents"))
    cut = t.docs.select("doc_id", "text", textfn.shape_tokens(F.col("text")).alias("tokens"), textfn.sentences(F.col("text")).alias("sents"))
    return cut.select("doc_id", *[(F.round(c, 6) if "share" in n else c).alias(n) for n, c in cols.items()])


@query(rf"""WITH a AS (SELECT doc_id, len(regexp_extract_all(lower(text), '{_W}')) AS w,
 greatest(1, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_matches(s, '\S')))) AS s,
 len(regexp_extract_all(lower(text), '[aeiouyàâäéèêëîïôöùûüáíóúñ]+')) AS y FROM documents)
SELECT doc_id, round(206.835::DOUBLE - 1.015::DOUBLE * (w / s) - 84.6::DOUBLE * (y / nullif(w, 0)), 4) AS flesch,
 round(0.39::DOUBLE * (w / s) + 11.8::DOUBLE * (y / nullif(w, 0)) - 15.59::DOUBLE, 4) AS grade FROM a""")
def readability(t: Tables) -> DataFrame:
    return t.docs.select("doc_id", *[F.round(c, 4).alias(n) for n, c in textfn.readability(F.col("text")).items()])


@query(rf"""WITH a AS (SELECT doc_id, regexp_extract_all(lower(text), '{_W}') AS w FROM documents)
SELECT doc_id, round(list_sum(list_transform(w, lambda x: length(x))) / len(w), 6) AS avg_length,
 len(list_filter(w, lambda x: NOT regexp_matches(x, '[aeiou]')))::INTEGER AS n_no_vowel, len(list_filter(w, lambda x: length(x) >= 4))::INTEGER AS n_long FROM a""")
def word_lengths(t: Tables) -> DataFrame:
    w = textfn.words(F.col("text"))
    return t.docs.select("doc_id", F.round(textfn.average_word_length(w), 6).alias("avg_length"),
                              F.size(textfn.words_without_vowels(w)).alias("n_no_vowel"), F.size(textfn.long_words(w)).alias("n_long"))


@query(r"""SELECT sum(len(string_split(text, chr(10))))::BIGINT AS n_lines, sum(len(regexp_extract_all(text, '[^\s]+')))::BIGINT AS n_words,
  sum(length(text))::BIGINT AS n_chars FROM documents""")
def corpus_size(t: Tables) -> DataFrame:
    return text.word_counts_total(t.docs, "text")


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\s]+', '', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents""")
def normalise_text(t: Tables) -> DataFrame:
    return t.docs.select("doc_id", F.md5(textfn.normalise_text(F.col("text"))).alias("digest"))


@query("SELECT doc_id, length(text) AS n_chars, md5(text) AS digest FROM documents")
def reassemble_fragments(t: Tables) -> DataFrame:
    """Texts cut into pieces of 100 characters and put together again."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(100))
    pieces = t.docs.select("doc_id", F.explode(starts).alias("offset"), "text").select(
        "doc_id", "offset", F.col("text").substr(F.col("offset") + 1, F.lit(100)).alias("text"))
    whole = text.reassemble_fragments(pieces, "doc_id", "offset", "text")
    return whole.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


@query(r"SELECT letter, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}')) AS letter FROM documents) GROUP BY letter")
def letter_counts(t: Tables) -> DataFrame:
    return text.letter_counts(t.docs, "text")


@query("WITH " + TOK_SQL + """, l AS (SELECT substr(term, 1, 1) AS first, substr(term, 2, 1) AS second FROM tok WHERE length(term) >= 2)
SELECT first, second, n, round(n / sum(n) OVER (PARTITION BY first), 3) AS share FROM (SELECT first, second, count(*) AS n FROM l GROUP BY first, second)""")
def second_letter_shares(t: Tables) -> DataFrame:
    w = t.docs.select(F.explode(textfn.words(F.col("text"))).alias("term"))
    return aggregate.letter_shares(w, "term")


@query(r"SELECT doc_id, md5(regexp_replace(text, '\bthe\b', 'THE', 'g')) AS digest FROM documents")
def replace_word(t: Tables) -> DataFrame:
    return t.docs.select("doc_id", F.md5(textfn.replace_word(F.col("text"), "the", "THE")).alias("digest"))


def _tokens_of(t: Tables, lang: str) -> DataFrame:
    return t.docs.filter(F.col("lang") == lang).select(F.explode(textfn.words(F.col("text"))).alias("term"))


@query("WITH " + TOK_SQL + "SELECT term, count(*) AS n FROM tok WHERE lang = 'en' AND term NOT IN (SELECT term FROM tok WHERE lang = 'de') GROUP BY term")
def words_subtracted(t: Tables) -> DataFrame:
    """Words of one language absent from another, duplicates kept and then counted."""
    return setops.subtract_all(_tokens_of(t, "en"), _tokens_of(t, "de"), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + TOK_SQL + "SELECT term FROM tok WHERE lang = 'en' INTERSECT SELECT term FROM tok WHERE lang = 'fr'")
def words_in_both(t: Tables) -> DataFrame:
    return setops.intersect_distinct(_tokens_of(t, "en"), _tokens_of(t, "fr"))


@query("WITH " + TOK_SQL + """SELECT term, count(*) AS n FROM (SELECT term FROM tok WHERE lang = 'en' UNION ALL SELECT term FROM tok WHERE lang = 'es') GROUP BY term""")
def words_of_either(t: Tables) -> DataFrame:
    return setops.union_all(_tokens_of(t, "en"), _tokens_of(t, "es")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + TOK_SQL + """, a AS (SELECT DISTINCT term FROM tok WHERE lang = 'en'), b AS (SELECT DISTINCT term FROM tok WHERE lang = 'de')
SELECT (SELECT count(*) FROM a) AS n_first, (SELECT count(*) FROM b) AS n_second, (SELECT count(*) FROM a JOIN b USING (term)) AS n_common""")
def vocabulary_overlap(t: Tables) -> DataFrame:
    return setops.overlap_sizes(_tokens_of(t, "en"), _tokens_of(t, "de"), "term")
