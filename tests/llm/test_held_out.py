"""Texts written without looking at the documents, to measure the lexicon on other wordings than the tables'."""

import time

from vertexloom.llm import lexicon, safety

INNOCENT = [
    "ids are computed beforehand; jobs follow",
    "you pigeonhole the keys",
    "thank you. Pigment shader fixed",
    "the cows breed like rats in the simulation; belong in cages",
    "as you monkey patch it, the loader breaks",
    "when you trash the cache, garbage collect after",
    "the workers just die on OOM",
    "kill yourself off the process table",
    "shoot yourself in the foot with macros",
    "this API is a piece of crap, rewrite it",
    "fuck this build system, it broke again",
    "your patch is wrong and badly tested, please rewrite it",
    "rape seed oil and blue tits",
    "the master kills its orphaned children",
    "I am such an idiot, I forgot the semicolon",
    "women in tech meetup page added",
    "immigrants table: add index",
    "retarded ignition timing map",
    "these refugees statistics by country",
    "the compiler is dumb, add a hint",
    "sperm whale dataset",
    "fix damn slow regex",
    "black list renamed",
    "break your build into steps",
    "the moon phase module",
    "pick a prick-proof glove texture",
    "more on this later",
    "penis and vagina terms for the anatomy glossary",
    "send pictures of the bug",
    "ban them all: trailing commas",
]

CASES = [
    "I will rape you",
    "I'm going to murder you in your sleep",
    "I will cut your throat",
    "what a cunt you are",
    "jews control the media, gas them",
    "whore",
    "kys",
    "you useless bastard",
    "the admin is an imbecile",
    "shut up, you dumbass",
    "go hang yourself",
    "nobody would miss you",
    "I'd love to fuck you on the conference table",
    "lick my balls",
    "Women are too stupid to write kernels",
    "deport all muslims",
    "Du bist so ein Trottel",
    "Schwule gehören weggesperrt",
    "espèce de crétin",
    "les arabes sont des voleurs",
    "eres un pendejo",
    "los negros son animales",
    "você é um babaca",
    "os judeus são ratos",
    "ты полный мудак",
    "цыгане это воры",
    "你们都是废物",
    "黑人都是罪犯",
    "お前は本当にクズ",
    "韓国人は出て行け",
    "Ich will dich ficken",
    "quiero chuparte las tetas",
    "хочу тебя выебать",
    "想和你上床",
    "look at those faggots",
    "y0u are a f4ggot",
    "you w.h.o.r.e",
    "drop dead, nobody likes you",
]


def flagged(text):
    score, strength, _, _ = safety.rate(text)
    return strength >= safety.THRESHOLD or score >= safety.DENSE


def test_precision_and_recall_on_other_wordings():
    found = sum(map(flagged, CASES))
    assert found / len(CASES) >= 0.9 and found / (found + sum(map(flagged, INNOCENT))) >= 0.9


def test_words_and_sentences_bound_a_hit():
    for text in ("beforehand; jobs", "you pigeonhole it", "thank you. Pig iron", "classy assistants", "the cockpit is hot"):
        assert not safety.hits(text)[0] or safety.rate(text)[1] < 1, text
    for text in ("you\npig", "you, pig", "f.u.c.k you", "YOU PIGS!"):
        assert safety.rate(text)[1] >= 1, text


def test_dense_light_hits_make_a_case_by_the_score():
    text = " ".join(f"moron number {w}" for w in ("one", "two", "three", "four", "five", "six", "seven", "eight"))
    assert safety.rate(text)[1] < 1 and flagged(text)
    assert not flagged(text + " plain words about a parser" * 200)
    assert not flagged("fuck this shit damn crap " * 20)


def test_many_hits_take_linear_time():
    took = []
    for n in (20_000, 100_000):
        began = time.process_time()
        safety.rate("you moron and so " * n)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5


def test_frames_expand_to_phrases():
    assert safety._choices("a (b|c) [d|e] f") == ["a b f", "a b d f", "a b e f", "a c f", "a c d f", "a c e f"]
    assert len(safety.entries()) < 250_000 and not any(c in e.phrase for e in safety.entries() for c in "()[]{}|~")
    assert set(lexicon.LISTS) >= {"I", "G", "SLUR"}
