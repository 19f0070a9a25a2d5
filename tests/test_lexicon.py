"""Lexicon data: sizes of the fixed tables."""
import re

from hypothesis import given, strategies as st

from sortwise.functions import lexicon as L
from sortwise.functions.patterns import trie_regex


def test_verb_lexicon_sizes():
    forms = L.verb_forms()
    assert len(forms) == 445
    assert len(set(L.verb_map().values())) == 48
    assert len(L.infinitives()) == 50
    assert "subir" in L.infinitives() and "fazer download" in L.infinitives()


def test_verb_form_examples():
    m = L.verb_map()
    assert m["marque"] == "marcar" and m["marquei"] == "marcar"
    assert m["pague"] == "pagar" and m["pago"] == "pagar"
    assert m["exclui"] == "excluir" and m["exclua"] == "excluir"
    assert m["sobe"] == "fazer upload" and m["upload"] == "fazer upload"
    assert m["faca"] == "fazer" and m["fizeram"] == "fazer"
    assert m["veja"] == "ver" and m["visualizando"] == "ver"
    assert m["procurando"] == "buscar" and m["download"] == "baixar"
    assert m["impresso"] == "imprimir" and m["transfira"] == "transferir"


def test_set_sizes():
    assert len(L.SYSTEM_KEYWORDS) == 238 == len(set(L.SYSTEM_KEYWORDS))
    assert len(L.INTEGRATION_OBJECTS) == 59
    assert len(L.EMAIL_CONTEXTS) == 20
    assert len(L.SHARE_CONTEXTS) == 15
    assert len(L.SCHEDULE_CONTEXTS) == 35
    assert len(L.CANCEL_CONTEXTS) == 24
    assert len(L.INTEGRATION_EXCLUSIONS) == 37
    assert len(L.SCOPE_PATTERNS) == 29


def test_required_verbs_present():
    """J11 on the shipped lexicon: nothing required is missing."""
    required = {"enviar", "mandar", "disparar", "encaminhar", "agendar", "marcar", "reservar",
                "criar", "gerar", "produzir", "compartilhar", "fazer upload", "subir",
                "responder", "editar", "modificar", "fazer download", "baixar",
                "sincronizar", "fazer", "excluir", "deletar", "remover", "cancelar",
                "reagendar"}
    assert required - set(L.infinitives()) == set()


words = st.lists(st.text(alphabet="abcde .@-", min_size=1, max_size=5), min_size=1, max_size=8)


@given(words, st.text(alphabet="abcde .@-xyz", max_size=30))
def test_trie_regex_is_substring_any(lits, text):
    pat = re.compile(trie_regex(lits))
    assert bool(pat.search(text)) == any(w in text for w in lits)
