"""Options of a run, the layout of the parameter vector, and its bounds."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from ..functions.kernels import kernel

MODES = ("estimation", "prediction", "full")
PARTITIONS = ("linear", "none")
CLUSTERINGS = ("random", "kmeans++")
PRECISIONS = {"double": "double", "fp64": "double", "64": "double", "float": "float", "single": "float", "fp32": "float", "32": "float"}
#: Parameters of the extremes model after variance, nugget and the shared range.
SCE_NAMES = ("lambda_a", "kappa_a", "beta", "mu", "tau", "delta1")


@dataclass(frozen=True)
class Options:
    num_total_points: int = 20_000
    num_total_blocks: int = 1_000
    m: int = 200
    num_total_points_test: int = 2_000
    num_total_blocks_test: int = 100
    m_test: int = 120
    distance_scale: tuple[float, ...] = ()
    distance_scale_init: tuple[float, ...] = ()
    distance_threshold_coarse: float | None = None
    distance_threshold_finer: float | None = None
    kernel_type: str = "matern32"
    precision: str = "double"
    theta_init: tuple[float, ...] = ()
    lower_bounds: tuple[float, ...] = ()
    upper_bounds: tuple[float, ...] = ()
    train_path: str = ""
    test_path: str = ""
    dim: int = 8
    seed: int = 0
    kmeans_max_iter: int = 10
    clustering: str = "random"
    maxeval: int = 5_000
    xtol_rel: float = 1e-5
    ftol_rel: float = 1e-5
    mode: str = "estimation"
    partition: str = "linear"
    num_parts: int = 1
    num_simulations: int = 1_000
    nn_multiplier: float = 99_999
    model_type: str = "gp"
    sce_params: tuple[float, ...] = (0.1,) * 6
    anchor_loc: tuple[float, ...] = ()
    anchor_val: float = 0.0
    log_append: str = ""

    def checked(self) -> Options:
        """The options with defaults that depend on others filled in; raises ValueError for what can't run."""
        kernel(self.kernel_type)
        for name, value, known in (("mode", self.mode, MODES), ("partition", self.partition, PARTITIONS), ("clustering", self.clustering, CLUSTERINGS), ("model_type", self.model_type, ("gp", "sce"))):
            if value not in known:
                raise ValueError(f"{name} must be one of {', '.join(known)}, not {value!r}")
        if self.precision.lower() not in PRECISIONS:
            raise ValueError(f"unknown precision {self.precision!r}")
        if self.dim < 1:
            raise ValueError("dim must be positive")
        if self.model_type == "sce":
            if self.dim != 2:
                raise ValueError("the extremes model is defined for two coordinates")
            if len(self.sce_params) != len(SCE_NAMES):
                raise ValueError(f"the extremes model takes {len(SCE_NAMES)} parameters: {', '.join(SCE_NAMES)}")
            if self.anchor_val < 0:
                raise ValueError("the anchor's value must not be negative")
        scale = self.distance_scale or (1.0,) * self.dim
        if len(scale) != self.dim:
            raise ValueError("distance_scale must have one entry for each coordinate")
        return replace(self, precision=PRECISIONS[self.precision.lower()], distance_scale=scale, distance_scale_init=self.distance_scale_init or scale, anchor_loc=self.anchor_loc or (0.0,) * self.dim)

    @property
    def range_offset(self) -> int:
        return 3 if kernel(self.kernel_type).has_smoothness else 2


@dataclass(frozen=True)
class Theta:
    """A parameter vector taken apart."""

    variance: float
    nugget: float
    ranges: tuple[float, ...]
    smoothness: float = 0.0
    extremes: dict[str, float] = field(default_factory=dict)


def initial_theta(o: Options) -> tuple[float, ...]:
    """[variance, (smoothness,) nugget, ranges...], for the extremes model one shared range and six parameters."""
    head = o.theta_init or ((1.0, 0.5, 1e-5) if o.range_offset == 3 else (1.0, 1e-5))
    if o.model_type == "sce":
        return (*head, (o.distance_scale_init or (1.0,))[0], *o.sce_params)
    return (*head, *(o.distance_scale_init or (1.0,) * o.dim))


def unpack(o: Options, theta: tuple[float, ...]) -> Theta:
    k = o.range_offset
    smoothness = theta[1] if k == 3 else 0.0
    if o.model_type == "sce":
        return Theta(theta[0], theta[k - 1], (theta[k],) * o.dim, smoothness, dict(zip(SCE_NAMES, theta[k + 1 :], strict=True)))
    return Theta(theta[0], theta[k - 1], tuple(theta[k : k + o.dim]), smoothness)


def bounds(o: Options, theta: tuple[float, ...]) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Given bounds, or [theta / 1000, 10 theta] in order, with fixed ones for variance, smoothness and nugget."""
    low = list(o.lower_bounds or [min(0.001 * t, 10 * t) for t in theta])
    high = list(o.upper_bounds or [max(0.001 * t, 10 * t) for t in theta])
    if not o.lower_bounds and not o.upper_bounds:
        low[0], high[0] = 0.01, 2.0 if kernel(o.kernel_type).name == "matern72" else 3.0
        low[o.range_offset - 1], high[o.range_offset - 1] = 0.0, 0.1
        if o.range_offset == 3:
            low[1], high[1] = 0.01, 2.0
    return tuple(low), tuple(high)
