"""The features of a frame and the default parameters; names and numbers are fixed values."""

from __future__ import annotations

#: Features of a frame that the structure chain gives, with the stage that makes them; fixed values.
FEATURES = [
    ("cell_mask_area", "frame", "cell_mask"),
    ("cell_mask_area_ratio", "frame", "cell_mask"),
    ("cell_mask_intensity", "frame", "cell_mask"),
    ("n_zbands", "frame", "z_bands"),
    ("z_intensity_mean", "frame", "z_bands"),
    ("z_intensity_std", "frame", "z_bands"),
    ("z_length_max", "frame", "z_bands"),
    ("z_length_mean", "frame", "z_bands"),
    ("z_length_std", "frame", "z_bands"),
    ("z_oop", "frame", "z_bands"),
    ("z_mask_area", "frame", "z_bands"),
    ("z_mask_area_ratio", "frame", "z_bands"),
    ("z_mask_intensity", "frame", "z_bands"),
    ("z_straightness_mean", "frame", "z_bands"),
    ("z_straightness_std", "frame", "z_bands"),
    ("z_lat_alignment_mean", "frame", "z_bands"),
    ("z_lat_alignment_std", "frame", "z_bands"),
    ("z_lat_alignment_groups_mean", "frame", "z_bands"),
    ("z_lat_alignment_groups_std", "frame", "z_bands"),
    ("z_lat_dist_mean", "frame", "z_bands"),
    ("z_lat_dist_std", "frame", "z_bands"),
    ("z_lat_length_groups_mean", "frame", "z_bands"),
    ("z_lat_length_groups_std", "frame", "z_bands"),
    ("z_lat_neighbors_mean", "frame", "z_bands"),
    ("z_lat_neighbors_std", "frame", "z_bands"),
    ("z_lat_size_groups_mean", "frame", "z_bands"),
    ("z_lat_size_groups_std", "frame", "z_bands"),
    ("n_mbands", "frame", "vectors"),
    ("n_vectors", "frame", "vectors"),
    ("sarcomere_area", "frame", "vectors"),
    ("sarcomere_area_ratio", "frame", "vectors"),
    ("sarcomere_length_mean", "frame", "vectors"),
    ("sarcomere_length_std", "frame", "vectors"),
    ("sarcomere_oop", "frame", "vectors"),
    ("sarcomere_orientation_mean", "frame", "vectors"),
    ("sarcomere_orientation_std", "frame", "vectors"),
    ("myof_length_max", "frame", "lines"),
    ("myof_length_mean", "frame", "lines"),
    ("myof_length_std", "frame", "lines"),
    ("myof_bending_mean", "frame", "lines"),
    ("myof_bending_std", "frame", "lines"),
    ("myof_straightness_mean", "frame", "lines"),
    ("myof_straightness_std", "frame", "lines"),
    ("n_domains", "frame", "domains"),
    ("domain_area_mean", "frame", "domains"),
    ("domain_area_std", "frame", "domains"),
    ("domain_oop_mean", "frame", "domains"),
    ("domain_oop_std", "frame", "domains"),
]

PARAMETERS: dict[str, object] = {
    "cell_mask.threshold": 0.1,
    "z_bands.threshold": 0.5,
    "z_bands.segment_threshold": 0.15,
    "z_bands.min_length": 0.2,
    "z_bands.median_filter_radius": 0.2,
    "z_bands.theta_phi_min": 0.4,
    "z_bands.a_min": 0.3,
    "z_bands.d_max": 3.0,
    "z_bands.d_min": 0.0,
    "vectors.radius": 0.25,
    "vectors.line_width": 0.2,
    "vectors.interpolation_factor": 0,
    "vectors.length_limits": (1.0, 3.0),
    "lines.ratio_seeds": 0.1,
    "lines.persistence": 3,
    "lines.threshold_distance": 0.5,
    "lines.n_min": 4,
    "lines.median_filter_radius": 0.5,
    "domains.d_max": 3.0,
    "domains.cosine_min": 0.65,
    "domains.resolution": 0.06,
    "domains.random_seed": 42,
    "domains.area_min": 20.0,
    "domains.dilation_radius": 0.3,
    "loi.n_lois": 4,
    "loi.persistence": 4,
    "loi.mode": "longest_in_cluster",
    "loi.number_limits": (10, 50),
    "loi.length_limits": (0.0, 200.0),
    "loi.cluster_threshold": 40.0,
    "loi.linkage": "single",
    "loi.line_width": 0.65,
    "peaks.threshold": 0.2,
    "peaks.min_distance": 1.4,
    "peaks.width": 0.5,
    "tracking.search_range": 2.0,
    "tracking.memory": 10,
    "tracking.memory_interpolation": 3,
    "contractions.threshold": 0.3,
    "contractions.slen_limits": (1.2, 3.0),
    "contractions.n_min": 4,
    "contractions.buffer_frames": 3,
    "contractions.contr_time_min": 0.2,
    "contractions.merge_time_max": 0.05,
    "trajectories.slen_limits": (1.2, 3.0),
    "trajectories.filter_vel": (13, 5),
    "trajectories.filter_pos": (13, 7),
    "trajectories.equ_limits": (1.5, 2.3),
    "popping.threshold": 0.25,
}


def parameters(**changes: object) -> dict[str, str]:
    """Defaults with changes (dots as double underscores), as text, for a params map column; unknown names raise."""
    out = dict(PARAMETERS)
    for k, v in changes.items():
        name = k.replace("__", ".")
        if name not in out:
            raise KeyError(name)
        out[name] = v
    return {k: str(v) for k, v in out.items()}
