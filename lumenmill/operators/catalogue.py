"""The 76 catalogue transformations as data.

A line is one transformation: name, family, D (moves all four planes) or I
(colour planes only, alpha kept), how its result gets back to the input's shape,
then each parameter with its kind, default and bounds (an open side is empty).
Kinds: pf pair or number, pi pair or whole number, sc number, sz whole number,
en choice, bo flag, fi whole number.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass
from typing import Any

INTERPOLATIONS = ("nearest", "bilinear", "bicubic", "area", "lanczos")
BORDERS = ("constant", "replicate", "reflect", "wrap", "reflect_101")

# Names, defaults and bounds decide the ids of what is made.
TABLE = """
vertical_flip dihedral D
rotate geometric D | limit pf (-90,90) (-360.0,360.0) | interpolation en 'bilinear' {interp} | border_mode en 'constant' {border} | fill fi 0
shift_scale_rotate geometric D | shift_limit pf (-0.0625,0.0625) (-1.0,1.0) | shift_limit_x pf None (-1.0,1.0) | shift_limit_y pf None (-1.0,1.0) | scale_limit pf (-0.1,0.1) (-1.0,) | rotate_limit pf (-45,45) (-360.0,360.0) | interpolation en 'bilinear' {interp} | border_mode en 'constant' {border} | fill fi 0
elastic_transform geometric D | alpha sc 1 (0.0,) | sigma sc 50 (1.0,) | interpolation en 'bilinear' {interp} | border_mode en 'constant' {border} | fill fi 0
median_blur blur I | blur_limit pi (3,7) (3,255)
motion_blur blur I | blur_limit pi (3,7) (3,255) | allow_shifted bo True | angle_range pf (0,360) (0.0,360.0) | direction_range pf (-1.0,1.0) (-1.0,1.0)
unsharp_mask blur I | blur_limit pi (3,7) (3,255) | sigma_limit sc 0.0 (0.0,) | alpha pf (0.2,0.5) (0.0,1.0) | threshold sc 10 (0,255)
gauss_noise noise I | std_range pf (0.2,0.44) (0.0,1.0) | mean_range pf (0.0,0.0) (-1.0,1.0) | per_channel bo True | noise_scale_factor sc 1 (0.0,1.0)
salt_and_pepper noise I | amount pf (0.01,0.06) (0.0,1.0) | salt_vs_pepper pf (0.4,0.6) (0.0,1.0)
color_jitter color I | brightness pf (0.8,1.2) (0.0,) | contrast pf (0.8,1.2) (0.0,) | saturation pf (0.8,1.2) (0.0,) | hue pf (-0.5,0.5) (-0.5,0.5)
hue_saturation_value color I | hue_shift_limit pi (-20,20) (-180,180) | sat_shift_limit pi (-30,30) (-255,255) | val_shift_limit pi (-20,20) (-255,255)
random_gamma color I | gamma_limit pi (80,120) (1,)
solarize color I | threshold_range pf (0.5,0.5) (0.0,1.0)
equalize color I | mode en 'cv' {cv,pil} | by_channels bo True
coarse_dropout dropout D | num_holes_range pi (1,2) (1,) | hole_height_range pf (0.1,0.2) (0.0,) | hole_width_range pf (0.1,0.2) (0.0,) | fill fi 0
erasing dropout D | scale pf (0.02,0.33) (0.0,) | ratio pf (0.3,3.3) (0.0,) | fill fi 0
image_compression compression I | compression_type en 'jpeg' {jpeg,webp} | quality_range pi (99,100) (1,100)
downscale compression I | scale_range pf (0.25,0.25) (0.0,1.0)
random_crop geometric D resize_back | height sz required (1,) | width sz required (1,) | border_mode en 'constant' {border} | fill fi 0
pad_if_needed geometric D crop_back | min_height sz 1024 (1,) | min_width sz 1024 (1,) | pad_height_divisor sz None (1,) | pad_width_divisor sz None (1,) | position en 'center' {center,top_left,top_right,bottom_left,bottom_right,random} | border_mode en 'constant' {border} | fill fi 0
gaussian_blur blur I | sigma_limit pf (0.5,3.0) (0.0,)
random_brightness_contrast color I | brightness_limit pf (-0.2,0.2) (-1.0,1.0) | contrast_limit pf (-0.2,0.2) (-1.0,1.0) | ensure_safe_range bo False
d4 dihedral D
square_symmetry dihedral D
safe_rotate geometric D | limit pf (-90,90) (-360.0,360.0) | interpolation en 'bilinear' {interp} | border_mode en 'constant' {border} | fill fi 0
affine geometric D | scale pf (1.0,1.0) (0.0,) | rotate pf 0.0 (-360.0,360.0) | shear pf (0.0,0.0) (-360.0,360.0) | translate_percent pf None (-1.0,1.0) | translate_px pi None (,) | interpolation en 'bilinear' {interp} | border_mode en 'constant' {border} | fill fi 0
perspective geometric D | scale pf (0.05,0.1) (0.0,1.0) | interpolation en 'bilinear' {interp} | border_mode en 'constant' {border} | fill fi 0
grid_distortion geometric D | num_steps sc 5 (1,) | distort_limit pf (-0.3,0.3) (-1.0,1.0) | interpolation en 'bilinear' {interp} | border_mode en 'constant' {border} | fill fi 0
optical_distortion geometric D | distort_limit pf (-0.05,0.05) (-1.0,1.0) | interpolation en 'bilinear' {interp} | border_mode en 'constant' {border} | fill fi 0
piecewise_affine geometric D | scale pf (0.03,0.05) (0.0,) | nb_rows pi (4,4) (1,) | nb_cols pi (4,4) (1,) | interpolation en 'bilinear' {interp} | border_mode en 'constant' {border} | fill fi 0
thin_plate_spline geometric D | scale_range pf (0.2,0.4) (0.0,) | num_control_points sc 4 (4,) | interpolation en 'bilinear' {interp} | border_mode en 'constant' {border} | fill fi 0
grid_elastic_deform geometric D | num_grid_xy pi required (1,) | magnitude sc required (0,) | interpolation en 'bilinear' {interp}
blur blur I | blur_limit pi (3,7) (3,255)
advanced_blur blur I | blur_limit pi (3,7) (3,255) | sigma_x_limit pf (0.2,1.0) (0.0,) | sigma_y_limit pf (0.2,1.0) (0.0,) | rotate_limit pf (-90,90) (-360.0,360.0)
defocus blur I | radius pi (3,10) (1,) | alias_blur pf (0.1,0.5) (0.0,1.0)
zoom_blur blur I | max_factor pf (1,1.31) (1.0,) | step_factor pf (0.01,0.03) (0.0,1.0)
sharpen blur I | alpha pf (0.2,0.5) (0.0,1.0) | lightness pf (0.5,1.0) (0.0,1.0)
ringing_overshoot blur I | blur_limit pi (7,15) (3,255) | cutoff pf (0.7853981633974483,1.5707963267948966)
additive_noise noise I | noise_type en 'uniform' {uniform,gaussian} | approximation sc 1.0 (0.0,1.0)
multiplicative_noise noise I | multiplier pf (0.9,1.1) (0.0,) | per_channel bo False | elementwise bo False
shot_noise noise I | scale_range pf (0.1,0.3) (0.0,)
isonoise noise I | color_shift pf (0.01,0.05) (0.0,) | intensity pf (0.1,0.5) (0.0,)
auto_contrast color I | cutoff sc 0 (0,100) | method en 'cdf' {cdf,pixel}
clahe color I | clip_limit sc 4.0 (0.0,) | tile_grid_size pi (8,8) (1,)
fancy_pca color I | alpha sc 0.1 (0.0,)
invert_img color I
posterize color I | num_bits sc 4 (1,8)
rgb_shift color I | r_shift_limit pi (-20,20) (-255,255) | g_shift_limit pi (-20,20) (-255,255) | b_shift_limit pi (-20,20) (-255,255)
random_tone_curve color I | scale sc 0.1 (0.0,) | per_channel bo False
planckian_jitter color I | mode en 'blackbody' {blackbody,cied} | sampling_method en 'uniform' {uniform,gaussian} | temperature_limit pi None (1000,15000)
illumination color I | mode en 'linear' {linear,corner,gaussian} | intensity_range pf (0.01,0.2) (0.0,1.0) | effect_type en 'both' {both,brighten,darken} | angle_range pf (0,360) (0.0,360.0) | sigma_range pf (0.2,1.0) (0.0,)
plasma_brightness_contrast color I | brightness_range pf (-0.3,0.3) (-1.0,1.0) | contrast_range pf (-0.3,0.3) (-1.0,1.0) | plasma_size sc 256 (1,) | roughness sc 3.0 (0.0,)
plasma_shadow color I | shadow_intensity_range pf (0.3,0.7) (0.0,1.0) | plasma_size sc 256 (1,) | roughness sc 3.0 (0.0,)
morphological color D | scale pi (2,3) (1,) | operation en 'dilation' {dilation,erosion}
channel_shuffle color I
channel_dropout color I | channel_drop_range pi (1,1) (0,) | fill fi 0
chromatic_aberration color I | primary_distortion_limit pf (-0.02,0.02) (-1.0,1.0) | secondary_distortion_limit pf (-0.05,0.05) (-1.0,1.0) | mode en 'green_purple' {green_purple,red_blue,random} | interpolation en 'bilinear' {interp}
grid_dropout dropout D | ratio sc 0.5 (0.0,1.0) | unit_size_range pi None (2,) | holes_number_xy pi None (1,) | random_offset bo True | fill fi 0
pixel_dropout dropout D | dropout_prob sc 0.01 (0.0,1.0) | per_channel bo False | drop_value sc 0 (0,255)
xy_masking dropout D | num_masks_x sc 0 (0,) | num_masks_y sc 0 (0,) | mask_x_length sc 0 (0,) | mask_y_length sc 0 (0,) | fill fi 0
frequency_masking dropout D | freq_mask_param sc 30 (0,)
random_grid_shuffle dropout D | grid pi (3,3) (1,)
random_fog weather I | alpha_coef sc 0.08 (0.0,1.0) | fog_coef_range pf (0.3,1) (0.0,1.0)
random_rain weather I | slant_range pi (-10,10) (-45,45) | drop_length sc None (1,) | drop_width sc 1 (1,) | blur_value sc 7 (0,) | brightness_coefficient sc 0.7 (0.0,) | rain_type en 'default' {default,drizzle,heavy,torrential}
random_shadow weather I | num_shadows_limit pi (1,2) (1,) | shadow_dimension sc 5 (1,) | shadow_intensity_range pf (0.5,0.5) (0.0,1.0)
random_snow weather I | brightness_coeff sc 2.5 (0.0,) | snow_point_range pf (0.1,0.3) (0.0,1.0) | method en 'bleach' {bleach,texture}
random_sun_flare weather I | src_radius sc 400 (1,) | angle_range pf (0,1) (0.0,1.0) | num_flare_circles_range pi (6,10) (0,) | method en 'overlay' {overlay,physics_based}
spatter weather I | mean pf (0.65,0.65) (0.0,1.0) | std pf (0.3,0.3) (0.0,1.0) | gauss_sigma pf (2,2) (0.0,) | cutout_threshold pf (0.68,0.68) (0.0,1.0) | intensity pf (0.6,0.6) (0.0,1.0) | mode en 'rain' {rain,mud}
center_crop geometric D resize_back | height sz required (1,) | width sz required (1,) | pad_if_needed bo False | border_mode en 'constant' {border} | fill fi 0
crop geometric D resize_back | x_min sz 0 (0,) | y_min sz 0 (0,) | x_max sz 1024 (1,) | y_max sz 1024 (1,) | pad_if_needed bo False | border_mode en 'constant' {border} | fill fi 0
random_crop_from_borders geometric D resize_back | crop_left sc 0.1 (0.0,1.0) | crop_right sc 0.1 (0.0,1.0) | crop_top sc 0.1 (0.0,1.0) | crop_bottom sc 0.1 (0.0,1.0)
random_scale geometric D resize_back | scale_limit pf (-0.1,0.1) (-1.0,) | area_for_downscale en 'none' {none,image,image_mask} | interpolation en 'bilinear' {interp}
random_resized_crop geometric D resize_back | size sz required (1,) | scale pf (0.08,1.0) (0.0,1.0) | ratio pf (0.75,1.3333333333333333) (0.0,) | area_for_downscale en 'none' {none,image,image_mask} | interpolation en 'bilinear' {interp}
random_sized_crop geometric D resize_back | min_max_height pi required (1,) | size sz required (1,) | w2h_ratio sc 1.0 (0.0,) | area_for_downscale en 'none' {none,image,image_mask} | interpolation en 'bilinear' {interp}
resize geometric D resize_back | height sz required (1,) | width sz required (1,) | interpolation en 'bilinear' {interp}
pad geometric D crop_back | padding sc 0 (0,) | border_mode en 'constant' {border} | fill fi 0
"""


@dataclass(frozen=True)
class Parameter:
    name: str
    kind: str
    default: Any = None
    required: bool = False
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] = ()


@dataclass(frozen=True)
class Entry:
    name: str
    family: str
    dual: bool
    shape: str
    parameters: tuple[Parameter, ...]


def _parameter(text: str) -> Parameter:
    name, kind, default, *rest = text.split(" ")
    domain = rest[0] if rest else ""
    choices: tuple[str, ...] = ()
    low = high = None
    if domain.startswith("{"):
        inner = domain[1:-1]
        choices = {"interp": INTERPOLATIONS, "border": BORDERS}.get(inner) or tuple(inner.split(","))
    elif domain:
        low, high = (float(v) if v else None for v in domain[1:-1].split(","))
    value = None if default == "required" else ast.literal_eval(default)
    if isinstance(value, tuple):
        value = [float(v) if kind == "pf" else int(v) for v in value]
    return Parameter(name, kind, value, default == "required", low, high, choices)


def entries() -> dict[str, Entry]:
    found = {}
    for line in TABLE.strip().splitlines():
        head, *parameters = line.split(" | ")
        name, family, planes, *shape = head.split(" ")
        found[name] = Entry(name, family, planes == "D", shape[0] if shape else "", tuple(map(_parameter, parameters)))
    return found


CATALOGUE = entries()
