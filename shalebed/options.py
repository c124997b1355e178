"""How an archive is written."""

from __future__ import annotations

from dataclasses import dataclass, replace

KIB = 1024


@dataclass(frozen=True)
class ArchiveOptions:
    """Settings of a writer; ``codec_level`` is zstd's, as it reaches the Parquet writer.

    ``raw`` and what goes with it (transform, auto_transform, auto_level, dictionary) belong to
    ``sources.raw``; trigrams, templates and sketches to ``sources.archive``.
    """

    block_size: int = 16_384
    codec_level: int = 1
    dictionary: bool = True
    dictionary_bytes: int = 64 * KIB
    dictionary_sample_bytes: int = 10 * KIB * KIB
    trigrams: bool = True
    raw: bool = False
    auto_transform: bool = False
    transform: str = "none"
    auto_level: bool = False
    templates: bool = False
    sketches: bool = False
    sketch_dim: int = 64
    sketch_bits: int = 4

    def with_(self, **changes) -> ArchiveOptions:
        """The same settings but for some; naming a transform turns the automatic choice off."""
        if "transform" in changes and "auto_transform" not in changes:
            changes["auto_transform"] = False
        return replace(self, **changes)

    def writer(self) -> dict[str, str]:
        """Options of the Parquet writer."""
        return {"compression": "zstd", "parquet.compression.codec.zstd.level": str(self.codec_level)}


#: The settings of the presets and of the levels.
def preset(name: str) -> ArchiveOptions:
    """The settings for a kind of use."""
    new = ArchiveOptions()
    mb = KIB * KIB
    return {
        "new": new,
        "realtime": new.with_(dictionary=False),
        "balanced": new.with_(codec_level=3),
        "archival": new.with_(codec_level=9, dictionary_bytes=128 * KIB),
        "search_optimized": new.with_(codec_level=3),
        "adaptive": new.with_(codec_level=6, dictionary_bytes=128 * KIB, dictionary_sample_bytes=5 * mb, raw=True, auto_transform=True, auto_level=True),
        "dna": new.with_(codec_level=3, dictionary_sample_bytes=2 * mb, raw=True, transform="dna_2bit"),
        "numeric": new.with_(codec_level=3, dictionary_bytes=32 * KIB, dictionary_sample_bytes=mb, raw=True, transform="numeric_delta"),
        "binary": new.with_(codec_level=6, dictionary_bytes=128 * KIB, dictionary_sample_bytes=5 * mb, raw=True, transform="binary_delta"),
        "nibble_split": new.with_(codec_level=6, dictionary_bytes=128 * KIB, dictionary_sample_bytes=5 * mb, raw=True, transform="nibble_split"),
        "structured": new.with_(codec_level=6, dictionary_bytes=128 * KIB, dictionary_sample_bytes=5 * mb, raw=True, transform="none"),
    }[name]


def level(n: int) -> ArchiveOptions:
    """Settings by one number from 1 to 22; the codec gets it as it is."""
    n = min(max(n, 1), 22)
    steps = min(n, 9) - 4
    if steps <= 0:
        return ArchiveOptions(codec_level=n, dictionary=False, dictionary_bytes=0, dictionary_sample_bytes=0)
    return ArchiveOptions(codec_level=n, dictionary_bytes=steps * 16 * KIB if n < 10 else KIB * KIB, dictionary_sample_bytes=steps * 256 * KIB if n < 10 else 20 * KIB * KIB)


def detected(transform: str, level: int, dictionary_bytes: int) -> ArchiveOptions:
    """Settings from what detection recommends: searchable, with trigrams."""
    return ArchiveOptions(codec_level=level, dictionary=dictionary_bytes > 0, dictionary_bytes=dictionary_bytes, transform=transform, trigrams=True)
