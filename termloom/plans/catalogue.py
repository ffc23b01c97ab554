"""Imports every module that registers queries."""

from termloom.plans import q_models, q_phrases, q_relations, q_sentences, q_tables, q_text, q_thesaurus, q_vectors, q_words  # noqa: F401
