"""Text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
#: Unicode white space, for trimming without a regular expression.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# What separates tokens, and what is trimmed from them.
TOKEN_SEPARATORS = "\n,.:;\"'"
TOKEN_WRAPPERS = "`()[]{}<>\"*#|/\\"

# Words without meaning of their own.
STOP_WORDS = (
    "the", "and", "for", "are", "was", "were", "that", "this", "with", "from", "have", "has", "had", "not", "but", "does", "did", "what", "when",
    "where", "which", "who", "how", "why", "its", "they", "them", "their", "there", "here", "about", "into", "onto", "over", "under", "than", "then",
    "these", "those", "such", "some", "any", "each", "both", "also", "can", "will", "would", "should", "could", "may", "might", "must",
)

# Concept and the words that stand for it.
CONCEPTS = {
    "develop": ("develop", "developed", "development", "emerge", "emerged", "emergent", "originate", "originated", "origin", "origins", "arise", "arose", "arises"),
    "independent": ("independent", "independently", "separate", "separately", "separation"),
    "recombine": ("recombine", "recombined", "recombination", "join", "joined", "joining", "merge", "merged", "merging", "synthesize", "synthesized", "synthesis"),
    "precede": ("upstream", "enable", "enabled", "precede", "preceded", "led", "lead"),
    "map": ("downstream", "reinterpret", "reinterpreted", "reframe", "reframed", "map", "mapped", "translate", "translated", "translation"),
    "summary": ("summary", "summaries", "summarize", "summarized", "overview", "overviews", "abstract"),
    "chunk": ("chunk", "chunks", "chunking", "segmentation"),
    "ingest": ("ingest", "ingestion", "ingested", "import", "imported"),
    "retrieve": ("retrieve", "retrieval", "retrieved"),
    "produce": ("artifact", "artifacts", "induced", "produce", "produced", "generate", "generated", "generation"),
    "transcript": ("transcript", "transcripts", "draft", "drafts"),
    "branch": ("branch", "branches"),
    "lineage": ("lineage",),
    "hybrid": ("hybrid", "hybrids"),
    "tradition": ("tradition", "traditions"),
    "terminology": ("term", "terms", "terminology"),
    "vocabulary": ("vocabulary", "vocab"),
    "connection": ("connection", "connections"),
    "bridge": ("bridge", "bridges"),
    "apparent": ("apparent",),
    "appear": ("appears", "appear"),
    "absent": ("absent", "absence"),
    "sacred": ("sacred",),
    "symbolic": ("symbolic", "symbolism"),
    "technical": ("technical",),
}
# Concepts that name a relation, and its family.
RELATIONS = {
    "develop": "DEVELOP_ORIGIN",
    "independent": "INDEPENDENT",
    "recombine": "RECOMBINE",
    "precede": "PRECEDE_ENABLE",
    "map": "REINTERPRET_MAP",
    "summary": "SUMMARY_OVERVIEW",
    "chunk": "CHUNKING",
    "ingest": "INGESTION",
    "retrieve": "RETRIEVAL",
    "produce": "ARTIFACT_PRODUCE",
}
# Signals of negation and of doubt.
NEGATION_PHRASES = ("does not", "did not", "do not", "no evidence", "rather than", "separate from", "unrelated to", "independent of")
NEGATION_WORDS = ("never", "without", "instead", "contrary", "however", "not")
NEGATION_STEMS = ("contradict", "inconsisten")
HEDGE_WORDS = ("may", "might", "possibly", "perhaps", "unclear", "uncertain", "ambiguous", "whether", "maybe")


def trimmed(col: Column) -> Column:
    """Without Unicode white space at either end; null becomes empty."""
    return F.btrim(F.coalesce(col, F.lit("")), F.lit(SPACES))


def present(col: Column) -> Column:
    """The trimmed text, or null where nothing is left."""
    return F.nullif(trimmed(col), F.lit(""))


def first_present(*cols: Column) -> Column:
    """The first text that is not blank."""
    return F.coalesce(*(present(col) for col in cols), F.lit(""))


def clamp_body(col: Column, n: int) -> Column:
    """The first ``n`` code points and an ellipsis beyond."""
    text = trimmed(col)
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def clamp_total(col: Column, n: int) -> Column:
    """At most ``n`` code points, the ellipsis included."""
    text = trimmed(col)
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


MARK = "\x01"


def tokens(col: Column) -> Column:
    """Lower-case words, separators taken for spaces."""
    apart = TOKEN_SEPARATORS + SPACES.replace("\n", "").replace(" ", "")
    spaced = F.translate(F.lower(F.coalesce(col, F.lit(""))), apart, " " * len(apart))
    return F.filter(F.split(spaced, " +"), lambda t: t != "")


def lexical_tokens(col: Column) -> Column:
    """Tokens without brackets, quotes and slashes around them."""
    return F.filter(F.transform(tokens(col), lambda t: F.btrim(t, F.lit(TOKEN_WRAPPERS))), lambda t: t != "")


def query_words(query: str) -> list[str]:
    """The tokens of :func:`lexical_tokens` of a text at hand."""
    spaced = query.lower().translate(str.maketrans(dict.fromkeys(TOKEN_SEPARATORS + SPACES, " ")))
    return [word for token in spaced.split(" ") if (word := token.strip(TOKEN_WRAPPERS))]


def token_pattern(token: str) -> str:
    """Matches lower-case texts that have ``token`` among their :func:`lexical_tokens`."""
    apart, around = (f"[{''.join(f'{chr(92)}x{{{ord(c):x}}}' for c in chars)}]" for chars in (TOKEN_SEPARATORS + SPACES, TOKEN_WRAPPERS))
    literal = "".join(f"\\x{{{ord(c):x}}}" for c in token)
    return f"(?:^|{apart}){around}*{literal}{around}*(?:$|{apart})"


def tokens_in(text: Column, wanted: list[str]) -> Column:
    """How many of ``wanted`` (repeats included) are among the :func:`lexical_tokens` of ``text``, which is in lower case.

    Separators become spaces and wrappers a mark, once for each text. A token between spaces is found by a plain
    search; only one that touches a mark is looked for by its pattern.
    """
    apart = TOKEN_SEPARATORS + SPACES
    marked = F.concat(F.lit(" "), F.translate(text, apart + TOKEN_WRAPPERS, " " * len(apart) + MARK * len(TOKEN_WRAPPERS)), F.lit(" "))

    def found(s: Column, token: str) -> Column:
        pattern = s["text"].rlike(token_pattern(token))
        if set(token) & {MARK, *TOKEN_WRAPPERS}:
            return pattern
        return s["marked"].contains(f" {token} ") | ((s["marked"].contains(MARK + token) | s["marked"].contains(token + MARK)) & pattern)

    # Bound as a lambda's variable, so that both forms of the text are made once.
    both = F.array(F.struct(text.alias("text"), marked.alias("marked")))
    return F.get(F.transform(both, lambda s: sum((found(s, token).cast("int") for token in wanted), F.lit(0))), F.lit(0))


def query_tokens(col: Column) -> Column:
    """Distinct runs of ASCII letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(col), "[^a-z0-9]+"), lambda t: t != ""))


def words(col: Column) -> Column:
    """Runs of Unicode letters and digits, lower case."""
    return F.filter(F.split(F.lower(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def meaningful_tokens(col: Column) -> Column:
    """Distinct words of three bytes, or two with a digit, that are no stop words (T4)."""
    long_enough = F.filter(words(col), lambda t: (F.octet_length(t) >= 3) | ((F.octet_length(t) == 2) & t.rlike("[0-9]")))
    return F.array_except(F.array_distinct(long_enough), F.array(*map(F.lit, STOP_WORDS)))


def concepts(col: Column) -> Column:
    """Meaningful tokens mapped to the concepts they stand for (T5)."""
    pairs = [F.lit(x) for concept, names in CONCEPTS.items() for name in names for x in (name, concept)]
    known = F.create_map(*pairs)
    return F.array_distinct(F.transform(meaningful_tokens(col), lambda t: F.coalesce(F.element_at(known, t), t)))


def lexical_overlap(a: Column, b: Column) -> Column:
    """Share of the meaningful tokens of ``a`` that ``b`` has."""
    left = meaningful_tokens(a)
    return F.when(F.size(left) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(left, meaningful_tokens(b))) / F.size(left))


def contains_any(col: Column, phrases: Sequence[str]) -> Column:
    """One alternation of literals: a single pass, whatever the number of phrases."""
    import re

    return col.rlike("|".join(re.escape(phrase) for phrase in phrases))


def negated(col: Column) -> Column:
    """Phrases, whole words or stems of negation."""
    return contains_any(F.lower(col), NEGATION_PHRASES + NEGATION_STEMS) | F.arrays_overlap(words(col), F.array(*map(F.lit, NEGATION_WORDS)))


def hedged(col: Column) -> Column:
    """Whole words of doubt."""
    return F.arrays_overlap(words(col), F.array(*map(F.lit, HEDGE_WORDS)))


def dedupe_key(col: Column) -> Column:
    """Lower case with single spaces."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), SPACE, " "))


def cluster_key(col: Column) -> Column:
    """Separators to single underscores."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(col), r"[ |/\\:\-]", "_"), "_+", "_"), F.lit("_"))


def clean_id(col: Column, keep_unknown: bool = False) -> Column:
    """Letters, digits, ``_`` and ``-``; others go, or become ``_``."""
    lower = F.lower(col)
    if keep_unknown:
        return F.btrim(F.regexp_replace(lower, "[^a-z0-9_-]", "_"), F.lit("_"))
    return F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(lower, r"[ ./\\]", "_"), "[^a-z0-9_-]", ""), "_+", "_"), F.lit("_"))


def family_key(col: Column) -> Column:
    """Title without marks of copies, letters and digits only."""
    text = F.lower(trimmed(col))
    for mark in ("(1)", "(2)", " copy", "_copy", "-copy"):
        text = F.replace(text, F.lit(mark), F.lit(""))
    return F.regexp_replace(text, "[^a-z0-9]", "")


def speaker_role(col: Column) -> Column:
    """``user, assistant, system, tool, mixed, unknown``; aliases are mapped."""
    raw = F.lower(trimmed(col))
    return F.when(raw.isin("user", "assistant", "system", "tool", "mixed", "unknown"), raw).when(raw.isin("ai", "model", "bot"), F.lit("assistant")).otherwise(F.lit("unknown"))


def clock(seconds: Column) -> Column:
    """``mm:ss``, from an hour on ``hh:mm:ss``."""
    whole = F.floor(seconds).cast("long")
    h, m, s = F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))


def clean_title(file: Column) -> Column:
    """A file's name without its ending, underscores for spaces."""
    return F.trim(F.translate(F.regexp_replace(file, r"\.[^.]*$", ""), "_", " "))


def attachment_ref(col: Column) -> Column:
    """Without scheme."""
    return trimmed(F.regexp_replace(col, r"^[^:/]*://", ""))


def turn_number(memory_id: Column) -> Column:
    return F.regexp_extract(memory_id, r"^(.+)_turn_(\d+)_chunk_(\d+)$", 2)


def suggestions(col: Column) -> Column:
    """Items of a last line ``SUGGESTIONS: a | b``."""
    lines = F.filter(F.split(col, "\n"), lambda line: F.trim(line) != "")
    last = F.element_at(lines, -1)
    items = F.filter(F.transform(F.split(F.regexp_extract(last, r"^\s*SUGGESTIONS:(.*)$", 1), r"\|"), lambda item: F.trim(item)), lambda item: item != "")
    return F.when(F.size(lines) > 0, items).otherwise(F.array().cast("array<string>"))


# Words of contradiction, words without discrimination, and signals of a message with their kind, importance and tag.
CONTRADICTIONS = ("contradict", "however", "inconsistent", "does not")
GENERIC = ("generic", "structure", "framework", "architecture", "generally", "broadly", "typically")
SIGNALS = (
    (("remember this",), "user_preference", 0.94, "remember-this"),
    (("actually", "correction", "i meant"), "user_preference", 0.96, "correction"),
    (("i prefer", "my preference", "for me"), "user_preference", 0.88, "preference"),
    (("we decided", "decision", "let's do"), "project_decision", 0.9, "decision"),
    (("must", "constraint", "cannot", "can't"), "technical_solution", 0.9, "constraint"),
    (("plan", "next step", "action item"), "project_decision", 0.86, "action-item"),
    (("persona", "identity"), "user_preference", 0.86, "persona"),
)
# Types of files by their endings.
MIME_TYPES = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "heic": "image/heic",
    "dng": "image/x-adobe-dng", "pdf": "application/pdf", "mp3": "audio/mpeg", "wav": "audio/wav", "mp4": "video/mp4",
}


def contradiction_signal(col: Column) -> Column:
    """Whether a text speaks against something."""
    return contains_any(F.lower(F.coalesce(col, F.lit(""))), CONTRADICTIONS)


def without_generic(col: Column) -> Column:
    """Lower-case words that are not generic; the text as it is if none is left."""
    kept = F.filter(F.split(F.lower(trimmed(col)), SPACE), lambda w: (w != "") & ~w.isin(*GENERIC))
    return F.when(F.size(kept) == 0, trimmed(col)).otherwise(F.array_join(kept, " "))


def message_signal(col: Column, remember: Column | None = None) -> Column:
    """``struct<kind, importance, tag>`` of the first signal in a message; nulls without one."""
    text = F.lower(trimmed(col))
    found = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(0.0).alias("importance"), F.lit(None).cast("string").alias("tag"))
    for number, (phrases, kind, importance, tag) in reversed(list(enumerate(SIGNALS))):
        test = contains_any(text, phrases)
        found = F.when((test | remember) if number == 0 and remember is not None else test, F.struct(F.lit(kind).alias("kind"), F.lit(importance).alias("importance"), F.lit(tag).alias("tag"))).otherwise(found)
    return found


def mime_type(file: Column) -> Column:
    """By the ending; empty for others."""
    types = F.create_map(*(F.lit(x) for pair in MIME_TYPES.items() for x in pair))
    return F.coalesce(F.element_at(types, F.lower(F.regexp_extract(F.coalesce(file, F.lit("")), r"\.([^./\\]*)$", 1))), F.lit(""))


def listed(col: Column) -> Column:
    """Distinct upper-case items of a comma list."""
    return F.array_distinct(F.filter(F.transform(F.split(F.upper(col), ","), lambda x: F.trim(x)), lambda x: x != ""))


def hypothesis_list(col: Column) -> Column:
    """``array<struct<id, statement, rank>>`` of ``id|statement; statement; ...``."""
    parts = F.transform(F.split(col, ";"), lambda x, n: F.struct(F.trim(x).alias("t"), (n + 1).alias("rank")))
    named = lambda p: p["t"].contains("|")
    one = lambda p: F.struct(
        F.coalesce(F.when(named(p), F.nullif(F.trim(F.substring_index(p["t"], "|", 1)), F.lit(""))), F.concat(F.lit("H"), p["rank"].cast("string"))).alias("id"),
        F.when(named(p), F.trim(F.regexp_replace(p["t"], r"^[^|]*\|", ""))).otherwise(p["t"]).alias("statement"), p["rank"].alias("rank"),
    )
    return F.transform(F.filter(parts, lambda p: p["t"] != ""), one)



def unescaped(col: Column) -> Column:
    r"""A text with ``\n``, ``\t`` or ``\r`` written out, decoded if it is a JSON string's content; else trimmed."""
    text = trimmed(col)
    literal = F.concat(F.lit('["'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"]'))
    decoded = F.get(F.from_json(literal, "array<string>"), F.lit(0))
    return F.when(text.rlike(r"\\[ntr]") & ~text.contains("\n"), F.coalesce(decoded, text)).otherwise(text)


def tag_list(repeated: Column, joined: Column) -> Column:
    """Tags of a request: given several times, each perhaps a list with commas, and then those of one more list."""
    raw = F.concat(F.coalesce(repeated, F.array().cast("array<string>")), F.array(F.coalesce(joined, F.lit(""))))
    return F.filter(F.transform(F.flatten(F.transform(raw, lambda r: F.split(F.coalesce(r, F.lit("")), ","))), lambda t: F.trim(t)), lambda t: t != "")


def optional_flag(col: Column) -> Column:
    """A flag of a request; null where it says neither yes nor no."""
    text = F.lower(F.trim(F.coalesce(col, F.lit(""))))
    return F.when(text.isin("true", "1", "yes", "y"), True).when(text.isin("false", "0", "no", "n"), False)
