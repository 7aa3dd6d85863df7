"""Public tokenizer files, opened once per Python process. Paths are parameters."""

from __future__ import annotations

import base64
import functools


@functools.lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank (which is also the id) of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str, special: tuple[tuple[str, int], ...] = ()):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path),
                             special_tokens=dict(special))
