import random
from collections import Counter

import pytest

from ledgerfold.llm import quality_rules as qr
from ledgerfold.llm._common import SPACES, words_of
from tests.llm.conftest import sentence


def brute(text):
    text = text or ""
    words = words_of(text)
    lines = [line for line in text.split("\n") if words_of(line)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(c not in SPACES for c in text), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def test_counts(docs, none):
    rng = random.Random(9)
    texts = ["a b c d e f g h " * 3, "x " * 40, "a b c d e f g h i a b c d e f g h", "\n\n a\n a\n \n", "a\x1cb\x85c d", " ".join(rng.choice("ab") for _ in range(300))]
    for t in texts:
        assert qr.judge(t)[:6] == brute(t), t
    rows = docs.collect()
    wanted = [(r.doc_id, *brute(r.text)) for r in rows]
    got = qr.quality_report(docs).collect()
    assert sorted([tuple(g)[:7] for g in got], key=str) == sorted(wanted, key=str)
    assert not any(g.kept and g.base_failed for g in got)
    assert qr.quality_report(none).collect() == []


CLEAN = "\n".join(sentence(random.Random(i), 30) for i in range(5))


@pytest.mark.parametrize(
    "line, rule",
    [
        ("Home | News | Sport | Weather | Contact", "navigation"), ("home about contact login", "navigation"), ("THIS IS!! ALL!! SHOUTED!! HERE!!", "punctuation"),
        ("this### is*** all%%% junk&&& here$$$", "punctuation"), ("again again again again again again", "boilerplate"),
        ("News » Sport » Cricket » Scores", "navigation"), ("Startseite Kontakt Impressum Anmelden", "navigation"), ("Accueil Aide Contact", "navigation"), ("inicio contacto acceder", "navigation"),
        ("alle Rechte vorbehalten", "boilerplate"), ("Tous droits réservés.", "boilerplate"), ("Todos los derechos reservados", "boilerplate"),
        ("DER GANZE TEXT STEHT IN GROSSEN BUCHSTABEN HIER", "punctuation"), (" ".join(f"w{i}" for i in range(60)) + " privacy policy", None),
        (" ".join(f"w{i}" for i in range(60)) + " privacy policy all rights reserved", "boilerplate"),
        ("Copyright 2020 All rights reserved", "boilerplate"), ("We use cookies to improve this site.", "boilerplate"),
        ("The quick brown fox & its friends ran home, and it was 100% fine.", None), ("Short title", None), ("What is it? It is a question of some length.", None),
    ],
)
def test_lines(line, rule):
    assert qr.line_fails(line, words_of(line), qr.LineRules()) == rule
    out = qr.judge(CLEAN + "\n" + line)
    assert out[6]
    assert out[7] == (CLEAN if rule else CLEAN + "\n" + line)


def test_clean_text_is_left_alone():
    assert qr.judge(CLEAN)[6:] == (True, CLEAN)


def test_losing_too_much_rejects():
    junk = "\n".join("these### are*** all%%% junk&&& words$$$ " + sentence(random.Random(i), 2).replace(" ", "### ") for i in range(9))
    assert qr.judge(sentence(random.Random(1), 30) + "\n" + junk)[5:7] == (False, False)


def test_keep_good(spark, docs, none):
    kept = qr.keep_good(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    wanted = Counter((r.doc_id, qr.judge(r.text)[7]) for r in docs.collect() if qr.judge(r.text)[6])
    rows = kept.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == wanted
    assert all(r.n_chars == len(r.text) for r in rows)
    assert qr.keep_good(none).collect() == []


def test_every_phrase_has_a_key():
    """Texts without a key aren't searched for phrases, so each of them has to have one."""
    phrases = (
        "All Rights Reserved|Privacy Policy|terms of use|terms of service|cookie policy|cookie settings|cookie notice|accept cookies|Accept all cookies|we use cookies|enable JavaScript|JavaScript is disabled|"
        "javascript is required|subscribe to our newsletter|sign up for our newsletter|click here to|share on facebook|share this on twitter|Lorem ipsum|powered by WordPress|page not found|© x|(c) x|Copyright x|"
        "TOUS DROITS RÉSERVÉS|politique de confidentialité|conditions d'utilisation|accepter les cookies|accepter tous les cookies|mentions légales|inscrivez-vous à notre newsletter|cliquez ici pour|activer javascript|"
        "alle Rechte vorbehalten|DATENSCHUTZERKLÄRUNG|Nutzungsbedingungen|cookies akzeptieren|alle cookies akzeptieren|newsletter abonnieren|hier klicken|klicken Sie hier|javascript aktivieren|"
        "todos los derechos reservados|política de privacidad|condiciones de uso|aceptar las cookies|aceptar todas las cookies|aviso legal|suscríbete a nuestro boletín|haga clic aquí|activar javascript"
    ).split("|")
    for p in phrases:
        assert qr._BOILERPLATE.search(p), p
        assert any(k in p.casefold() for k in qr.BOILERPLATE_KEYS), p
        assert qr.judge(CLEAN + "\n" + p)[7] == CLEAN, p
