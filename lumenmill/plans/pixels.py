"""Pixels of the catalogue held against arithmetic written out as SQL.

Parameters are pinned so that nothing is left to chance. A case is an entry of a
job and the value of plane ``c`` at row ``y`` and column ``x`` of its 4 x 4 RGBA
result; ``b`` is the frame as 64 numbers, row by row. The SQL states what each
effect does and shares nothing with the kernels.
"""

from __future__ import annotations

import re


def at(y: str = "y", x: str = "x", c: str = "c") -> str:
    return f"b[({y}) * 16 + ({x}) * 4 + ({c}) + 1]"


V = at()


def near(value: str) -> str:
    """A real value as a byte: nearest, halves to even, within 0..255."""
    return f"CAST(greatest(0e0, least(255e0, round_even(CAST({value} AS DOUBLE), 0))) AS INT)"


def colours(value: str) -> str:
    """An effect that keeps alpha."""
    return f"CASE WHEN c = 3 THEN {V} ELSE {value} END"


def mirrored(i: str) -> str:
    """An index beyond the border, reflected without repeating the border."""
    return f"CASE WHEN ({i}) < 0 THEN -({i}) WHEN ({i}) > 3 THEN 6 - ({i}) ELSE ({i}) END"


def clamped(i: str) -> str:
    return f"greatest(0, least(3, {i}))"


def around(offsets_y, offsets_x, edge) -> list[str]:
    return [at(edge(f"y + {i}"), edge(f"x + {j}")) for i in offsets_y for j in offsets_x]


def weighted(weights: list[str], reach: int) -> str:
    """A separable blur with mirrored edges."""
    k = range(-reach, reach + 1)
    terms = [f"{at(mirrored(f'y + {i}'), mirrored(f'x + {j}'))} * {weights[i + reach]} * {weights[j + reach]}" for i in k for j in k]
    return f"({' + '.join(terms)}) / pow({' + '.join(weights)}, 2)"


def bell(sigma: str, reach: int) -> list[str]:
    return [f"exp(-0.5e0 * {k * k} / ({sigma} * {sigma}))" for k in range(-reach, reach + 1)]


def total(values: list[str]) -> str:
    return f"({' + '.join(values)})"


BLOCK = total([at(f"y // 2 * 2 + {i}", f"x // 2 * 2 + {j}") for i in (0, 1) for j in (0, 1)])
PLANE = "list_transform(range(16), lambda q: b[q * 4 + c + 1])"
NEXT = [-1, 0, 1]
THREE = around(NEXT, NEXT, mirrored)
EDGED = around(NEXT, NEXT, clamped)
SOFT = weighted(bell("0.8e0", 1), 1)
BRIGHTEST = f"greatest({at(c='0')}, {at(c='1')}, {at(c='2')})"

#: case, entry, value
EFFECTS = [
    ("vertical_flip", {}, at("3 - y")),
    ("rotate", {"limit": [180, 180]}, at("3 - y", "3 - x")),
    ("rotate", {"limit": [90, 90]}, at("x", "3 - y")),
    ("rotate", {"limit": [90, 90], "interpolation": "nearest"}, at("x", "3 - y")),
    ("safe_rotate", {"limit": [-180, -180]}, at("3 - y", "3 - x")),
    ("shift_scale_rotate", {"shift_limit_x": [0.25, 0.25], "shift_limit_y": [0, 0], "scale_limit": [0, 0], "rotate_limit": [0, 0]}, f"CASE WHEN x < 1 THEN 0 ELSE {at(x='x - 1')} END"),
    ("affine", {"translate_px": [1, 1], "fill": 9}, f"CASE WHEN x < 1 OR y < 1 THEN 9 ELSE {at('y - 1', 'x - 1')} END"),
    ("affine", {"translate_px": [-1, -1], "border_mode": "replicate"}, at(clamped("y + 1"), clamped("x + 1"))),
    ("affine", {"translate_px": [1, 1], "border_mode": "reflect_101"}, at(mirrored("y - 1"), mirrored("x - 1"))),
    ("affine", {"translate_px": [1, 1], "border_mode": "wrap"}, at("(y + 3) % 4", "(x + 3) % 4")),
    ("center_crop", {"height": 2, "width": 2}, at("1 + y // 2", "1 + x // 2")),
    ("crop", {"x_min": 0, "y_min": 1, "x_max": 3, "y_max": 4}, at("1 + y * 3 // 4", "x * 3 // 4")),
    ("pad_if_needed", {"min_height": 6, "min_width": 6, "position": "top_left", "fill": 8}, f"CASE WHEN x > 2 OR y > 2 THEN 8 ELSE {at('y + 1', 'x + 1')} END"),
    ("pad_if_needed", {"min_height": 6, "min_width": 6, "position": "bottom_right", "border_mode": "replicate"}, at(clamped("y - 1"), clamped("x - 1"))),
    ("resize", {"height": 2, "width": 2}, near(f"{BLOCK} / 4e0")),
    ("resize", {"height": 2, "width": 2, "interpolation": "area"}, near(f"{BLOCK} / 4e0")),
    ("random_scale", {"scale_limit": [-0.5, -0.5]}, near(f"{BLOCK} / 4e0")),
    ("random_resized_crop", {"size": 2, "scale": [1, 1], "ratio": [1, 1]}, near(f"{BLOCK} / 4e0")),
    ("random_sized_crop", {"min_max_height": [4, 4], "size": 2}, near(f"{BLOCK} / 4e0")),
    ("downscale", {"scale_range": [0.5, 0.5]}, colours(at("y // 2 * 2", "x // 2 * 2"))),
    ("blur", {"blur_limit": [3, 3]}, colours(near(f"{total(THREE)} / 9e0"))),
    ("median_blur", {"blur_limit": [3, 3]}, colours(f"list_sort([{', '.join(EDGED)}])[5]")),
    ("motion_blur", {"blur_limit": [3, 3], "allow_shifted": False, "angle_range": [0, 0], "direction_range": [0, 0]}, colours(near(f"{total(around([0], NEXT, mirrored))} / 3e0"))),
    ("motion_blur", {"blur_limit": [3, 3], "allow_shifted": False, "angle_range": [90, 90], "direction_range": [0, 0]}, colours(near(f"{total(around(NEXT, [0], mirrored))} / 3e0"))),
    ("gaussian_blur", {"sigma_limit": [1, 1]}, colours(near(weighted(bell("1e0", 3), 3)))),
    ("random_fog", {"fog_coef_range": [0, 0], "alpha_coef": 0}, colours(near(weighted(bell("1e0", 2), 2)))),
    ("sharpen", {"alpha": [0.5, 0.5], "lightness": [0.5, 0.5]}, colours(near(f"0.5e0 * {V} + 0.5e0 * (9.5e0 * {V} - {total(THREE)})"))),
    ("unsharp_mask", {"blur_limit": [3, 3], "alpha": [0.5, 0.5], "threshold": 10}, colours(near(f"CASE WHEN abs({V} - {SOFT}) > 10 THEN {V} + 0.5e0 * ({V} - {SOFT}) ELSE {V} END"))),
    ("morphological", {"scale": [3, 3], "operation": "dilation"}, f"greatest({', '.join(EDGED)})"),
    ("morphological", {"scale": [2, 2], "operation": "erosion"}, f"least({', '.join(around([-1, 0], [-1, 0], clamped))})"),
    ("invert_img", {}, colours(f"255 - {V}")),
    ("posterize", {"num_bits": 3}, colours(f"{V} // 32 * 32")),
    ("solarize", {"threshold_range": [0.5, 0.5]}, colours(f"CASE WHEN {V} < 128 THEN {V} ELSE 255 - {V} END")),
    ("random_gamma", {"gamma_limit": [150, 150]}, colours(near(f"255 * pow({V} / 255e0, 1.5e0)"))),
    ("random_brightness_contrast", {"brightness_limit": [0.2, 0.2], "contrast_limit": [-0.5, -0.5]}, colours(near(f"0.5e0 * {V} + 51"))),
    ("rgb_shift", {"r_shift_limit": [10, 10], "g_shift_limit": [-20, -20], "b_shift_limit": [30, 30]}, colours(near(f"{V} + [10, -20, 30][c + 1]"))),
    ("hue_saturation_value", {"hue_shift_limit": [0, 0], "sat_shift_limit": [-255, -255], "val_shift_limit": [0, 0]}, colours(BRIGHTEST)),
    ("color_jitter", {"brightness": [0.5, 0.5], "contrast": [1, 1], "saturation": [1, 1], "hue": [0, 0]}, colours(near(f"0.5e0 * {V}"))),
    ("equalize", {}, colours(f"CASE WHEN list_min({PLANE}) = list_max({PLANE}) THEN {V} ELSE " + near(f"(len(list_filter({PLANE}, lambda q: q <= {V})) - len(list_filter({PLANE}, lambda q: q = list_min({PLANE})))) * 255e0 / (16 - len(list_filter({PLANE}, lambda q: q = list_min({PLANE}))))") + " END")),
    ("auto_contrast", {}, colours(f"CASE WHEN list_min({PLANE}) = list_max({PLANE}) THEN {V} ELSE " + near(f"({V} - list_min({PLANE})) * 255e0 / (list_max({PLANE}) - list_min({PLANE}))") + " END")),
    ("random_tone_curve", {"scale": 0}, colours(near(f"0.75e0 * {V} + 0.75e0 * {V} * {V} / 255 - 0.5e0 * {V} * {V} * {V} / 65025"))),
    ("illumination", {"intensity_range": [0.5, 0.5], "effect_type": "brighten", "angle_range": [0, 0]}, colours(near(f"{V} * (1 + 0.5e0 * ((x / 3e0 - 0.5e0) + 0.5e0))"))),
    ("gauss_noise", {"std_range": [0, 0], "mean_range": [0.2, 0.2]}, colours(near(f"{V} + 51"))),
    ("multiplicative_noise", {"multiplier": [1.5, 1.5]}, colours(near(f"{V} * 1.5e0"))),
    ("salt_and_pepper", {"amount": [1, 1], "salt_vs_pepper": [1, 1]}, colours("255")),
    ("salt_and_pepper", {"amount": [1, 1], "salt_vs_pepper": [0, 0]}, colours("0")),
    ("channel_dropout", {"channel_drop_range": [3, 3], "fill": 11}, colours("11")),
    ("pixel_dropout", {"dropout_prob": 1, "drop_value": 9}, "9"),
    ("coarse_dropout", {"num_holes_range": [1, 1], "hole_height_range": [1.0, 1.0], "hole_width_range": [1.0, 1.0], "fill": 5}, "5"),
    ("erasing", {"scale": [1, 1], "ratio": [1, 1], "fill": 6}, "6"),
    ("grid_dropout", {"random_offset": False, "unit_size_range": [2, 2], "fill": 7}, f"CASE WHEN x % 2 = 0 AND y % 2 = 0 THEN 7 ELSE {V} END"),
    ("xy_masking", {"num_masks_x": 1, "mask_x_length": 4, "fill": 3}, "3"),
]

#: Effects without strength: the frame comes back, through the effect's whole path.
NEUTRAL = [
    ("elastic_transform", {"alpha": 0, "sigma": 1}),
    ("perspective", {"scale": [0, 0]}),
    ("grid_distortion", {"distort_limit": [0, 0]}),
    ("optical_distortion", {"distort_limit": [0, 0]}),
    ("piecewise_affine", {"scale": [0, 0]}),
    ("thin_plate_spline", {"scale_range": [0, 0]}),
    ("grid_elastic_deform", {"num_grid_xy": [2, 2], "magnitude": 0}),
    ("random_crop", {"height": 4, "width": 4}),
    ("random_crop_from_borders", {"crop_left": 0, "crop_right": 0, "crop_top": 0, "crop_bottom": 0}),
    ("pad", {"padding": 2}),
    ("zoom_blur", {"max_factor": [1, 1]}),
    ("isonoise", {"color_shift": [0, 0], "intensity": [0, 0]}),
    ("fancy_pca", {"alpha": 0}),
    ("planckian_jitter", {"temperature_limit": [6500, 6500]}),
    ("plasma_brightness_contrast", {"brightness_range": [0, 0], "contrast_range": [0, 0]}),
    ("plasma_shadow", {"shadow_intensity_range": [0, 0]}),
    ("chromatic_aberration", {"primary_distortion_limit": [0, 0], "secondary_distortion_limit": [0, 0]}),
    ("frequency_masking", {"freq_mask_param": 0}),
    ("random_grid_shuffle", {"grid": [1, 1]}),
    ("random_shadow", {"shadow_intensity_range": [0, 0]}),
    ("random_snow", {"brightness_coeff": 1}),
    ("spatter", {"intensity": [0, 0]}),
]

CASES = EFFECTS + [(name, given, V) for name, given in NEUTRAL]


def entry(name: str, given: dict) -> dict:
    return {"type": name, "seed": 7, **given}


def placed(value: str) -> str:
    """The 64 numbers of a result; y, x and c are a number's place."""
    return f"list_transform(range(64), lambda i: list_transform([{{'y': i // 16, 'x': i // 4 % 4, 'c': i % 4}}], lambda o: {_named(value)})[1])"


def sql(frames: str) -> str:
    """All cases over ``frames``, a query of (parent_id, b)."""
    parts = []
    for k, (name, _, value) in enumerate(CASES):
        parts.append(f"SELECT parent_id, {k} AS number, '{name}' AS algorithm, array_to_string({placed(value)}, ',') AS pixels FROM frames")
    return f"WITH frames AS ({frames}) " + " UNION ALL ".join(parts)


def _named(value: str) -> str:
    return re.sub(r"\b([yxc])\b(?!\s*\()", r"o.\1", value)
