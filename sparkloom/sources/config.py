"""Configuration files and their checks. YAML is read where the library is there; JSON always is."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from sparkloom.operators.policy import CorpusPolicy


def load_mapping(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML files need the yaml library; JSON ones do not") from e
    return yaml.safe_load(text) or {}


def load_policy(path: str) -> CorpusPolicy:
    return CorpusPolicy.from_mapping(load_mapping(path))


def _require(*rules: tuple[bool, str]) -> None:
    for ok, why in rules:
        if not ok:
            raise ValueError(why)


@dataclass(frozen=True)
class DecoderShape:
    """Sizes of a decoder, with what they must satisfy."""

    # The default shape.
    vocab_size: int = 32_768
    hidden_size: int = 768
    intermediate_size: int = 2560
    num_layers: int = 12
    num_attention_heads: int = 12
    num_key_value_heads: int = 4
    tie_word_embeddings: bool = True

    def __post_init__(self) -> None:
        sizes = [getattr(self, f.name) for f in fields(self) if f.name != "tie_word_embeddings"]
        _require(
            (all(x > 0 for x in sizes), "sizes must be positive"),
            (self.vocab_size <= 65_535, "the vocabulary must fit 16-bit shards"),
            (self.hidden_size % self.num_attention_heads == 0, "heads must divide the hidden size"),
            (self.num_attention_heads % self.num_key_value_heads == 0, "key-value heads must divide the heads"),
            (self.hidden_size // self.num_attention_heads % 2 == 0, "rotation needs an even head size"),
        )


@dataclass(frozen=True)
class Schedule:
    """Steps and rates of a training run."""

    learning_rate: float = 3e-4
    minimum_learning_rate: float = 3e-5
    warmup_steps: int = 1000
    max_steps: int = 50_000
    micro_batch: int = 1
    accumulation: int = 32
    sequence_length: int = 2048

    def __post_init__(self) -> None:
        _require(
            (0 <= self.minimum_learning_rate <= self.learning_rate, "rates are out of order"),
            (0 <= self.warmup_steps < self.max_steps, "warm-up must end before the run"),
            (min(self.micro_batch, self.accumulation, self.sequence_length) > 0, "batch sizes must be positive"),
        )

    @property
    def tokens_per_step(self) -> int:
        return self.micro_batch * self.accumulation * self.sequence_length

    def consumed(self, step: int) -> int:
        """Samples that a run resumed at ``step`` has used."""
        return step * self.micro_batch * self.accumulation


def _build(cls, values: dict | None, nested: dict | None = None):
    """``cls`` from a mapping; unknown keys are errors, lists become tuples, and ``nested`` keys are built by their classes."""
    values, nested = dict(values or {}), nested or {}
    unknown = sorted(values.keys() - {f.name for f in fields(cls)})
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    plain = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k not in nested}
    return cls(**plain, **{k: _build(c, values.get(k)) for k, c in nested.items()})


@dataclass(frozen=True)
class RunSettings:
    """Files, precision and cadence of a training run from scratch."""

    # The default run.
    train_dir: str = "data/processed/train"
    validation_dir: str = "data/processed/validation"
    validation_samples: int = 256
    num_workers: int = 2
    precision: str = "fp16"
    log_every: int = 10
    evaluate_every: int = 500
    save_every: int = 500
    keep_last_checkpoints: int = 3
    seed: int = 1337

    def __post_init__(self) -> None:
        _require(
            (self.precision in ("fp32", "fp16", "bf16"), "precision must be fp32, fp16 or bf16"),
            (min(self.validation_samples, self.log_every, self.evaluate_every, self.save_every, self.keep_last_checkpoints) > 0, "counts must be positive"),
            (self.num_workers >= 0, "num_workers is negative"),
        )

    def validation_seed(self, total_examples: int) -> int:
        """Seed of the validation samples, which must differ from that of any training sample."""
        return self.seed + total_examples


@dataclass(frozen=True)
class AdapterShape:
    """Low-rank adapters: size and the layers that they are put on."""

    rank: int = 16
    alpha: int = 32
    dropout: float = 0.05
    target_modules: tuple[str, ...] = ("q_proj", "k_proj", "v_proj", "o_proj", "gate_proj", "up_proj", "down_proj")

    def __post_init__(self) -> None:
        _require((self.rank > 0 and self.alpha > 0, "rank and alpha must be positive"), (0 <= self.dropout < 1, "dropout must lie from 0 to below 1"), (self.target_modules, "no layer is named"))


@dataclass(frozen=True)
class Quantization:
    enabled: bool = False
    quant_type: str = "nf4"
    double_quantization: bool = True

    def __post_init__(self) -> None:
        _require((self.quant_type in ("nf4", "fp4"), "quant_type must be nf4 or fp4"))


@dataclass(frozen=True)
class AdapterRun:
    """A run that fits adapters on conversations."""

    # The default run.
    train_files: tuple[str, ...] = ("data/train.jsonl",)
    validation_files: tuple[str, ...] = ("data/validation.jsonl",)
    sequence_length: int = 2048
    precision: str = "fp16"
    micro_batch_size: int = 1
    gradient_accumulation_steps: int = 32
    learning_rate: float = 1e-4
    epochs: float = 2.0
    max_steps: int | None = None
    dataloader_num_workers: int = 2
    assistant_mask_scope: str = "all"
    adapter: AdapterShape = AdapterShape()
    quantization: Quantization = Quantization()

    def __post_init__(self) -> None:
        _require(
            (self.precision in ("fp16", "bf16"), "precision must be fp16 or bf16"),
            (self.sequence_length >= 128, "sequence_length is below 128"),
            (min(self.micro_batch_size, self.gradient_accumulation_steps) > 0, "batch sizes must be positive"),
            (self.learning_rate > 0 and self.epochs > 0, "learning_rate and epochs must be positive"),
            (self.max_steps is None or self.max_steps > 0, "max_steps must be positive"),
            (self.dataloader_num_workers >= 0, "dataloader_num_workers is negative"),
            (self.assistant_mask_scope in ("all", "last"), "assistant_mask_scope must be all or last"),
            (self.train_files and self.validation_files, "files are missing"),
        )


def load_adapter_run(path: str) -> AdapterRun:
    return _build(AdapterRun, load_mapping(path), {"adapter": AdapterShape, "quantization": Quantization})


@dataclass(frozen=True)
class RuntimeLimits:
    """Bounds of a run of decisions, and the globs that it must not touch."""

    # The default bounds.
    max_steps: int = 64
    max_context_chars: int = 120_000
    max_observation_chars: int = 30_000
    max_file_bytes: int = 1_000_000
    command_timeout_seconds: int = 300

    def __post_init__(self) -> None:
        _require((min(getattr(self, f.name) for f in fields(self)) > 0, "limits must be positive"))


@dataclass(frozen=True)
class Host:
    """A code host: kind, repository, and the environment variable that holds its token (never the token itself)."""

    provider: str
    repository: str
    token_env: str
    base_url: str | None = None

    def __post_init__(self) -> None:
        _require(
            (self.provider in ("github", "gitlab", "gitea", "forgejo"), "unknown provider"),
            (self.repository.strip() and self.token_env.strip(), "a host needs repository and token_env"),
            (self.provider in ("github", "gitlab") or self.base_url, f"{self.provider} needs base_url"),
        )


def load_host(path: str) -> Host:
    values = load_mapping(path)
    return _build(Host, {**values, "provider": str(values.get("provider", "")).lower()})


def load_limits(path: str) -> RuntimeLimits:
    return _build(RuntimeLimits, load_mapping(path))
