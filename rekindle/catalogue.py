"""The algorithms, what feedback they need and how they are rated."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Entry:
    name: str
    feedback: str
    max_users: int | None
    max_items: int | None
    domain: str
    training_speed: str
    scalability: str
    robustness: str
    sparsity_fit: str
    interpretability: str
    production_readiness: str


# Feedback kind, size limits (users, items), domain, then ratings for training speed,
# scalability, robustness, sparsity fit, interpretability and production readiness.
CATALOGUE = {e.name: e for e in (
    Entry("SVD", "both", 25_000, 15_000, "general", "fast", "high", "high", "high", "medium", "high"),
    Entry("SVD++", "explicit", 5_000, 5_000, "general", "slow", "low", "medium", "medium", "medium", "medium"),
    Entry("NMF", "explicit", 15_000, 10_000, "general", "medium", "medium", "medium", "medium", "high", "high"),
    Entry("ALS", "implicit", None, None, "general", "fast", "high", "high", "high", "low", "high"),
    Entry("BPR", "implicit", None, None, "general", "medium", "high", "medium", "high", "low", "high"),
    Entry("Ecommerce-Popularity", "implicit", None, None, "ecommerce", "fast", "high", "high", "high", "high", "high"),
    Entry("Ecommerce-Purchase-ALS", "implicit", None, None, "ecommerce", "medium", "high", "high", "high", "medium", "high"),
    Entry("Movie-Item-KNN", "explicit", 20_000, 10_000, "movie", "medium", "medium", "medium", "low", "high", "medium"),
    Entry("Temporal-SVD", "both", 25_000, 12_000, "movie", "medium", "medium", "medium", "medium", "medium", "medium"),
    Entry("User-KNN", "both", 12_000, 20_000, "general", "medium", "medium", "medium", "medium", "high", "medium"),
    Entry("Item-KNN", "both", 20_000, 12_000, "general", "medium", "medium", "high", "medium", "high", "high"),
    Entry("EASE", "both", 50_000, 8_000, "general", "fast", "medium", "high", "high", "medium", "high"),
    Entry("LightFM", "both", 20_000, 8_000, "general", "medium", "medium", "medium", "high", "medium", "medium"),
    Entry("Autoencoder-CF", "both", 6_000, 3_000, "general", "slow", "low", "medium", "medium", "low", "medium"),
    Entry("Content-Based TF-IDF", "both", 25_000, 12_000, "general", "fast", "medium", "high", "high", "high", "high"),
    Entry("Factorization Machines", "both", 15_000, 8_000, "general", "slow", "medium", "medium", "high", "medium", "medium"),
)}

ALLOWED_FEEDBACK = {
    "explicit": {"explicit"},
    "implicit": {"implicit"},
    "hybrid": {"explicit", "implicit", "both"},
}


def incompatibility(entry: Entry, mode: str, both_is_universal: bool = False) -> str:
    """Empty text when the algorithm fits the mode. Size limits do not apply to the models here."""
    if entry.feedback in ALLOWED_FEEDBACK[mode] or (both_is_universal and entry.feedback == "both"):
        return ""
    return f"incompatible with mode={mode} (algo feedback={entry.feedback})"


def primary_metric(mode: str) -> tuple[str, str]:
    return ("RMSE", "minimize") if mode == "explicit" else ("NDCG@K", "maximize")
