"""Schemas of the tables that are read and written; nothing is inferred."""

from __future__ import annotations

PARAGRAPHS = "country string, year int, paragraph_id int, paragraph_text string, word_count int"
SCORES = PARAGRAPHS + ", criticism_hard_p1k double, criticism_soft_p1k double, severity_ratio double"
SUMMARY = "country string, year int, criticism_hard_p1k double, criticism_soft_p1k double, severity_ratio double"
TOPIC_SUMMARY = "country string, year int, topic string, n_paragraphs long, criticism_hard_p1k double, criticism_soft_p1k double, severity_ratio double"
SENTENCES = "year string, country string, topic string, label string, text string"
COUNTRY_YEAR = "country string, year int, reform_count long, crit_count long, word_count long, ReformScore double, CriticismScore double, NetScore double"
MANIFEST = "country string, country_slug string, year int, filename string, report_page string, pdf_url string, status string"
