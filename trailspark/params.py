"""Thresholds of the operators, all of them parameters. Fixed values in the units named."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Kinematics:
    min_frames: int = 12
    v_stop: float = 0.10  # car lengths per second
    v_move: float = 0.22
    min_run_s: float = 0.4
    sigma_meas: float = 0.04  # car lengths
    sigma_jerk: float = 0.35
    gate: float = 3.5
    flow_floor_px: float = 0.4
    jump: float = 2.0  # car lengths per frame
    accel: float = 2.5
    spike_window_s: float = 0.2
    scales_s: tuple = (0.16, 0.24, 0.36, 0.54, 0.8)
    search_s: tuple = (-2.0, 0.5)
    slip_s: float = 0.5  # over which a coherent slip shows in places


@dataclass(frozen=True)
class Slip:
    pool: int = 2
    min_affine: int = 10
    min_pool: int = 5
    min_frames: int = 10
    position_scale: float = 1000.0
    rounds: int = 2


@dataclass(frozen=True)
class Queue:
    refractory_s: float = 2.0
    margin: float = 0.15
    min_departures: int = 3


@dataclass(frozen=True)
class Quality:
    car_m: float = 4.5
    jerk: float = 15.0  # m/s^3
    slow_run: float = 0.1
    parked: float = 0.05
    band_kmh: tuple = (10.0, 25.0)
    lateral: float = 3.0
    boots: int = 2000
    seed: int = 3
    cell_s: float = 0.4


@dataclass(frozen=True)
class Roads:
    cell_px: int = 24
    min_hits: int = 3
    max_angle_deg: float = 55.0
    min_cells: int = 40
    min_spine: float = 4.0  # car lengths
    near: float = 3.5  # car lengths
    min_near: int = 200
    bins: int = 36
    min_in_bin: int = 10
    min_bins: int = 4
    smooth: float = 3.0  # bins
    lane_bin: float = 4.0
    low: float = 0.02
    high: float = 0.98
    lane_smooth: float = 1.6  # bins
    lane_part: float = 0.9 * 0.45  # of a car length, between two lanes
    lane_rise: float = 0.12  # of the highest bin
    lone_lane: float = 0.35  # of a car length


@dataclass(frozen=True)
class Focus:
    max_gap_s: float = 8.0
    stop_in: float = 1.0  # of v_stop
    stop_out: float = 1.8
    brake_in: float = 1.7  # of v_move
    brake_out: float = 2.2
    hold_s: float = 0.2
    lateral_px: float = 25.0
    off_road: float = 3.5  # car lengths
    reach_cars: float = 0.8
    reach_share: float = 0.3  # of the way driven in the gap


@dataclass(frozen=True)
class Anchors:
    min_marks: int = 6
    tolerance: float = 3.0  # world px
    min_frames: int = 5
    smooth: float = 2.0  # frames
