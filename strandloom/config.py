"""Run parameters with their allowed ranges."""

from __future__ import annotations

from dataclasses import dataclass, field

LOG_LEVELS = ("trace", "debug", "info", "warn", "error", "fatal")


@dataclass(frozen=True)
class RunConfig:
    """Parameters of one calling run; the defaults are the documented command-line ones."""

    vcf_files: tuple[str, ...] = ()
    ref_file: str = ""
    tumor_bam: str = ""
    normal_bam: str = ""
    bed_file: str = ""
    outdir: str = "./results"
    window_size: int = 2000
    meth_high_threshold: float = 0.8
    meth_low_threshold: float = 0.2
    min_allele: float = 0
    min_strand_reads: int = 1
    threads: int = 0
    gzip_output: bool = True
    max_read_depth: int = 10000
    max_ram_gb: int = 32
    log_level: str = "info"
    log_file: str = "strandloom.log"
    per_vcf: bool = field(default=True)

    def __post_init__(self) -> None:
        self._require(1 <= self.window_size <= 100000, "window_size must be in 1..100000")
        self._require(
            0.01 < self.meth_high_threshold <= 1.0, "meth_high_threshold must be in (0.01, 1]"
        )
        self._require(
            0.01 < self.meth_low_threshold < self.meth_high_threshold,
            "meth_low_threshold must be in (0.01, meth_high_threshold)",
        )
        self._require(self.min_allele >= 0, "min_allele must not be negative")
        self._require(self.min_strand_reads >= 0, "min_strand_reads must not be negative")
        self._require(
            100 <= self.max_read_depth <= 1000000, "max_read_depth must be in 100..1000000"
        )
        self._require(1 <= self.max_ram_gb <= 1024, "max_ram_gb must be in 1..1024")
        self._require(
            self.log_level.lower() in LOG_LEVELS, f"log_level must be one of {LOG_LEVELS}"
        )

    @staticmethod
    def _require(ok: bool, message: str) -> None:
        if not ok:
            raise ValueError(message)

    @classmethod
    def struct_defaults(cls, **overrides) -> "RunConfig":
        """The second set of defaults: values in force when an option is not given at all."""
        values = dict(
            window_size=100, min_strand_reads=3, min_allele=0.1, threads=8, outdir=""
        )
        values.update(overrides)
        return cls(**values)
