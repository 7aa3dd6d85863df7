"""Shared types and fixed vocabularies."""

from __future__ import annotations

# One finding inside a text. Offsets count code points; ``start`` is 0-based, ``end`` exclusive.
ITEM = ("struct<start:int,end:int,match:string,value:string,cat:string,kind:string,"
        "level:string,layer:string,ev:string,ph:string>")
ITEMS = f"array<{ITEM}>"
ITEM_FIELDS = ("start", "end", "match", "value", "cat", "kind", "level", "layer", "ev", "ph")

SPAN = "struct<s:int,e:int,v:string>"
SPANS = f"array<{SPAN}>"

WARNING = "struct<type:string,text:string,topic:string,why:string>"
WARNINGS = f"array<{WARNING}>"

# Levels, strongest first: always hidden; hidden but may be revealed; noted only.
LEVELS = ("high", "medium", "low")

# The categories a page can show as text, so that they are covered there too.
PAINTABLE = ("NAME", "ADDRESS", "PLACE", "ORG", "TERM", "SECRET", "CREDENTIAL", "USERNAME",
             "ACCOUNT", "UPI", "ID", "DOB", "AGE", "FINANCIAL", "PIN", "OTP", "CVV", "POSTAL",
             "IP", "COORD", "HEALTH", "ENCODED")

# Categories whose placeholders are numbered, with the word printed in the placeholder.
NUMBERED = {"NAME": "PERSON", "ADDRESS": "ADDRESS", "PLACE": "PLACE", "ORG": "ORG"}

# Fixed value: the grammar of a placeholder token.
PLACEHOLDER = r"\[[A-Z][A-Z_0-9]*(?::[^\]]*)?\]"

HIDDEN = "[HIDDEN]"
