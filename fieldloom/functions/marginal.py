"""The marginal transform of the conditional extremes model on arrays, for use inside likelihood kernels."""

from __future__ import annotations

import numpy as np

from .special import incomplete_gamma, log_gamma, normal_quantile


def transform(x: np.ndarray, obs: np.ndarray, p: dict[str, float], anchor: tuple[float, ...], anchor_value: float, eps: float = 1e-12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(latent values, log-densities, log b) of observations at the rows of x; always in double precision."""
    h = np.sqrt(((x - np.asarray(anchor)) ** 2).sum(axis=1))
    delta = 1 + np.exp(-((h / p["delta1"]) ** 2))
    a = anchor_value * np.exp(-((h / p["lambda_a"]) ** p["kappa_a"]))
    b = 1 + a ** p["beta"]
    z = (obs - a) / b
    v = (np.abs(z - p["mu"]) / p["tau"]) ** delta
    shape = 1 / delta
    log_f = np.log(delta / (2 * p["tau"])) - log_gamma(shape) - v
    u = 0.5 + 0.5 * np.sign(z - p["mu"]) * incomplete_gamma(shape, v)
    return normal_quantile(np.clip(u, eps, 1 - eps)), log_f, np.log(b)
