"""Named palettes, and looking them up."""

from __future__ import annotations

# The colours of published palettes, RRGGBB, or AARRGGBB where one isn't opaque.
_LISTED = {
    "pico-8": ("PICO-8", "000000 1d2b53 7e2553 008751 ab5236 5f574f c2c3c7 fff1e8 ff004d ffa300 ffec27 00e436 29adff 83769c ff77a8 ffccaa"),
    "gameboy": ("Game Boy", "0f380f 306230 8bac0f 9bbc0f"),
    "nes54": (
        "NES 54",
        "7c7c7c 0000fc 0000bc 4428bc 940084 a80020 f83800 e45c10 ac7c00 503000 007878 0078f8 0058f8 6844fc d800cc e40058 f8b800 acac00 "
        "30ac00 00b800 00a800 00a844 008888 54fc54 54fcb8 54fcfc 00fcfc 00e4d4 3cbc3c a80054 a80000 b8f818 f8b8f8 f8b8d8 787878 fc54fc "
        "f87858 fca044 f8b800 d8d8d8 3c3c3c b8f8b8 b8f8d8 fcfcb8 fcfcfc f8d8f8 f8d878 fcbcb0 fcfcfc bcbcbc fcbc3c 58007c 8c007c 580054",
    ),
    "endesga-32": (
        "Endesga 32",
        "e4a672 b86f50 743f39 3f2832 9e2835 e53b44 fb922b fe8501 ff004d f6d7bd ea8296 ad2e56 3e2442 702a4c b04a5a 97ced1 "
        "39547b 00000000 e5e1d9 cecbc6 3b3b49 22354c 45576d 66b4cd a8f2e2 364056 5c4754 675363 8c5a6a 4d6c6e 3385a2 27314a",
    ),
    "clawd": ("Clawd Warm", "fff1e8 ffa300 ff77a8 ab5236 5f574f 1d2b53"),
    "kimi": ("Kimi Blue", "daf3ff 29adff 1d2b53 7e2553 1b1b2e"),
}


def argb(digits: str) -> int:
    """A signed colour of six digits (opaque) or eight, alpha first."""
    value = int(digits, 16) | (0xFF000000 if len(digits) == 6 else 0)
    return value - (1 << 32) if value >= 1 << 31 else value


PALETTES: dict[str, list[int]] = {k: [argb(c) for c in colours.split()] for k, (_, colours) in _LISTED.items()}
NAMES: dict[str, str] = {k: name for k, (name, _) in _LISTED.items()}


def palette(name: str) -> list[int]:
    if name not in PALETTES:
        raise ValueError(f"unknown palette {name!r}")
    return PALETTES[name]


def search(text: str) -> list[str]:
    """Ids of the palettes whose id or name holds a text, whatever its case; all
    for a blank one."""
    part = text.strip().lower()
    return [k for k in PALETTES if part in k.lower() or part in NAMES[k].lower()]


def of_size(n: int) -> list[str]:
    """Ids of the palettes of n colours, give or take half."""
    if n < 1:
        raise ValueError("a palette has a colour at least")
    return [k for k, v in PALETTES.items() if n / 2 <= len(v) <= n * 1.5]
