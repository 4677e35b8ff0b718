"""Line-first quality rules.

Each line of a text is judged on its own: by its punctuation, as navigation and
as boilerplate. Failing lines are removed, and a document is rejected if too
much of its text went with them, or if it fails the base rules on words and
repeated windows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame

from ledgerfold.llm._common import SPACES, map_rows, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
_SYMBOL_BYTES = [s.encode() for s in SYMBOLS]

#: Phrases of boilerplate in English, French, German and Spanish; case doesn't matter.
BOILERPLATE = (
    "all rights reserved|privacy policy|terms of (?:use|service)|cookie (?:policy|settings|notice)|accept (?:all )?cookies|we use cookies"
    "|enable javascript|javascript is (?:disabled|required)|(?:subscribe to|sign up for) our newsletter|click here to|share (?:this )?on (?:facebook|twitter)"
    "|lorem ipsum|powered by wordpress|page not found|^[ \t]*(?:©|[(]c[)]|copyright ).*"
    "|tous droits réservés|politique de confidentialité|conditions d'utilisation|accepter (?:tous )?les cookies|mentions légales|inscrivez-vous à notre newsletter|cliquez ici pour|activer javascript"
    "|alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|(?:alle )?cookies akzeptieren|newsletter abonnieren|hier klicken|klicken sie hier|javascript aktivieren"
    "|todos los derechos reservados|política de privacidad|condiciones de uso|aceptar (?:todas )?las cookies|aviso legal|suscríbete a nuestro boletín|haga clic aquí|activar javascript"
)
#: Every phrase above has one of these, so that a text with none of them has no line to search.
BOILERPLATE_KEYS = (
    "rights reserved", "privacy policy", "terms of ", "cookie", "javascript", "newsletter", "click here to", "facebook", "twitter", "lorem ipsum", "powered by wordpress",
    "page not found", "©", "(c)", "copyright ", "droits réservés", "confidentialité", "conditions d'utilisation", "mentions légales", "cliquez ici", "rechte vorbehalten",
    "datenschutzerklärung", "nutzungsbedingungen", "hier klicken", "klicken sie hier", "derechos reservados", "de privacidad", "condiciones de uso", "aviso legal", "nuestro boletín", "haga clic",
)
#: Words of menus in the same languages.
NAVIGATION = (
    "home about contact login logout register menu search sitemap help faq next previous prev back top share print archive categories tags rss english "
    "accueil contacts connexion déconnexion inscription recherche aide suivant précédent retour imprimer archives catégories français plan "
    "startseite kontakt impressum anmelden abmelden registrieren suche hilfe weiter zurück drucken archiv kategorien datenschutz deutsch übersicht "
    "inicio contacto acceder salir registrarse buscar ayuda siguiente anterior volver imprimir archivo categorías etiquetas español mapa"
)
#: Separators between the entries of a menu.
MARKS = "|»›·•>"

_BOILERPLATE = regex.compile(f"(?i)(?:{BOILERPLATE})")
_NAVIGATION = frozenset(NAVIGATION.encode().split())
_MARKS = regex.compile(f"[{MARKS}]")
_LOWER, _UPPER = regex.compile(r"\p{Ll}"), regex.compile(r"\p{Lu}")


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the verdict; every share is of words unless it says otherwise."""

    max_symbol_share: float = 0.25  # words that hold a symbol
    max_shout_share: float = 0.5  # words that end in ! or ?, or in capitals, of a line of several
    max_mark_share: float = 0.3  # separators between words
    max_navigation_share: float = 0.5  # of a short line
    short_line: int = 8
    max_repeat_share: float = 0.5  # words equal to the word before
    max_boilerplate_share: float = 0.05  # words of boilerplate phrases
    max_lost: float = 0.5  # of a document's words
    min_words: int = 20
    max_repeated_percent: int = 30


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of ``window`` words that occur twice or more, first ones included."""
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.uint64)
    if len(numbers) == n:
        return 0
    # Hashes of windows; equal windows have equal hashes, so only these are compared whole.
    at = n - window + 1
    code = np.zeros(at, dtype=np.uint64)
    with np.errstate(over="ignore"):
        mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        for k in range(window):
            code = code * np.uint64(0xD1342543DE82EF95) + mixed[k : k + at]
            code ^= code >> np.uint64(32)
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(at, dtype=bool)
    twice[:-1] |= same
    twice[1:] |= same
    starts = order[twice]
    whole = [ids[s : s + window].tobytes() for s in starts.tolist()]
    count = Counter(whole)
    edges = np.zeros(n + 1, dtype=np.int64)
    for s, w in zip(starts.tolist(), whole, strict=True):
        if count[w] > 1:
            edges[s] += 1
            edges[s + window] -= 1
    return int((np.cumsum(edges[:n]) > 0).sum())


def line_fails(line: str, words: list[bytes], rules: LineRules, marks: bool = True, phrases: bool = True) -> str | None:
    """The rule that a line with words fails, if any; ``marks`` and ``phrases``: whether its text has any at all."""
    n = len(words)
    if marks and n >= 3 and len(_MARKS.findall(line)) > rules.max_mark_share * n:
        return "navigation"
    if any(map(line.count, SYMBOLS)) and sum(any(s in w for s in _SYMBOL_BYTES) for w in words) > rules.max_symbol_share * n:
        return "punctuation"
    if n >= 4:
        if (line.count("!") + line.count("?")) and sum(w[-1:] in (b"!", b"?") for w in words) > rules.max_shout_share * n:
            return "punctuation"
        if sum(map(bytes.__eq__, words, words[1:])) > rules.max_repeat_share * n:
            return "boilerplate"
        if n >= 8 and not _LOWER.search(line) and _UPPER.search(line):
            return "punctuation"
    if n <= rules.short_line and sum(w.lower().strip(b".,:;|>") in _NAVIGATION for w in words) > rules.max_navigation_share * n:
        return "navigation"
    found = _BOILERPLATE.findall(line) if phrases else None
    if found and sum(len(words_of(x)) for x in found) >= rules.max_boilerplate_share * n:
        return "boilerplate"
    return None


def judge(text: str | None, rules: LineRules = LineRules()):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned text)."""
    text = text or ""
    n_words = word_chars = n_dup = lost = 0
    words: list[bytes] = []
    seen: set[str] = set()
    marks = any(map(text.__contains__, MARKS))
    phrases = any(map(text.casefold().__contains__, BOILERPLATE_KEYS))
    left = []
    for line in text.split("\n"):
        own = words_of(line)
        if not own:
            left.append(line)
            continue
        words += own
        fails = line_fails(line, own, rules, marks, phrases)
        if line in seen:
            n_dup += 1
        else:
            seen.add(line)
        if fails:
            lost += len(own)
        else:
            left.append(line)
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))
    n_repeat = repeated_words(words)
    base_failed = n_words < rules.min_words or 100 * n_repeat > rules.max_repeated_percent * n_words
    kept = not base_failed and lost <= rules.max_lost * n_words
    return n_words, word_chars, n_symbols, n_dup, n_repeat, base_failed, kept, "\n".join(left) if lost else text


def quality_report(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Counts and verdict for every row of ``docs`` (doc_id, text).

    A null or empty text has no words and fails. Texts and lines of any length are
    judged whole. ``n_lost_words`` is what the line rules removed; of a text that
    loses just the share that it may, nothing is held against it. Rows are independent,
    repeated ones included, and further columns are ignored.
    """

    def start():
        def row(doc_id, text):
            out = judge(text, rules)
            yield (doc_id, *out[:7], out[0] - len(words_of(out[7])))

        return row

    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, n_lost_words long"
    )
    return map_rows(docs.select("doc_id", "text"), schema, start)


def keep_good(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, without the lines that failed.

    All columns come back; ``text`` is the cleaned text and ``n_chars``, if there
    is one, its length. Rejected documents, null and empty texts go.
    """
    import pyarrow as pa

    schema = docs.schema
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(at)
            keep, cleaned = [], []
            for i in range(batch.num_rows):
                out = judge(texts[i].as_py(), rules)
                if out[6]:
                    keep.append(i)
                    cleaned.append(out[7])
            rows = batch.take(pa.array(keep, pa.int32()))
            columns = list(rows.columns)
            columns[at] = pa.array(cleaned, texts.type)
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([len(t) for t in cleaned], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)
