"""Values that the registered queries and their SQL share."""

from __future__ import annotations

DOMAIN_OF_LANGUAGE = {"en": "News", "de": "Science", "fr": "Finance", "es": "Sports"}
MIN_LANGUAGE_SCORE = 0.15

#: Tags that begin or end a block of a page; a pattern for Java and RE2 alike.
BLOCK_TAG = r"</?(p|h[1-6]|li|ul|ol|div|article|section|header|footer|nav|main|aside|table|tr|form|br|body|title)([ /][^>]*)?>"

#: What each document gets before it is misread: accents, punctuation, Cyrillic and Devanagari letters.
THREE_SCRIPTS = " Déjà vu à l’été – größer, Привет мир, नमस्ते."
