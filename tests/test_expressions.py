import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.functions import identity as I
from sievewright.functions import kernels
from sievewright.functions import scores as S
from sievewright.sources import tables as src


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_generator_identity(spark):
    got = column(spark, [" Some Lab/Big_Model 2 ", "https://huggingface.co/Author\\Model A//", "--x--/.", None, "author/model-a", "author/model-b"], I.canonical_generator_id)
    assert got == ["some-lab/big-model-2", "author/model-a", "x", "", "author/model-a", "author/model-b"]


def test_identity_of_compatibility_characters(spark):
    assert column(spark, ["Ｓｔａｂｌｅ／Model①", " ﬁne Model ", None], I.canonical_generator_id) == ["stable/model1", "fine-model", ""]


def test_nfkc(spark):
    assert column(spark, ["ﬁ①", "plain"], lambda c: I.canonical_generator_id(I.nfkc(c))) == ["fi1", "plain"]


def test_real_source(spark):
    assert column(spark, ["landscapesHQ", "coco", "RAISE", "F-F H.Q", "VISION coco", "unknown", None], I.canonical_real_source) == ["Landscapes HQ", "COCO", "RAISE", "FFHQ", "VISION", "", ""]


def test_digest_keeps_nulls_apart(spark):
    import hashlib

    got = spark.sql("SELECT 'a' AS x, CAST(NULL AS STRING) AS y").select(I.stable_digest(7, F.col("x"), F.col("y"), F.lit(3))).first()[0]
    assert got == hashlib.sha256("7\x1fa\x1fNone\x1f3".encode()).hexdigest()


def test_paths_and_stems(spark):
    assert column(spark, ["../x.png", "/tmp/x.png", "", ".", "a/../x.png", "a\\b.png", "ok/x.png", None, "a//b"], I.is_safe_path) == [False] * 5 + [True, True, False, False]
    assert column(spark, ["../a/b c", "***", "x" * 100, None], I.safe_stem) == ["a_b_c", "image", "x" * 80, "image"]
    assert column(spark, ["jpeg", "PNG", "xyz", None], I.extension) == [".jpg", ".png", ".img", ".img"]


def test_cleaning(spark):
    assert column(spark, [" n/a ", "None", "", None, " x "], I.clean_nullish) == ["UNSPECIFIED"] * 4 + ["x"]
    assert column(spark, ["jpg", "Tif", "png", None], I.format_name) == ["JPEG", "TIFF", "PNG", "UNSPECIFIED"]
    assert column(spark, [0.0, 0.1, 0.11, 1.0, 5.0, 5.1], I.resolution_bin, "double") == ["<=0.10 MP", "<=0.10 MP", "0.10-0.30 MP", "0.30-1.00 MP", "1.00-5.00 MP", ">5.00 MP"]
    assert column(spark, [0, 1, 15, 16, 19, 20, 21], I.condition_group, "int") == ["clean", "single_stage", "single_stage", "two_stage", "four_stage", "six_stage", None]


def test_temperature_keeps_the_decision(spark):
    got = column(spark, [0.9965, 0.4, 0.5, 0.0, 1.0], lambda p: S.temperature_scale(p, 14.5), "double")
    want = [1 / (1 + np.exp(-np.log(min(max(p, 1e-7), 1 - 1e-7) / (1 - min(max(p, 1e-7), 1 - 1e-7))) / 14.5)) for p in (0.9965, 0.4, 0.5, 0.0, 1.0)]
    assert np.allclose(got, want)
    assert [g >= 0.5 for g in got] == [True, False, True, False, True]


def test_losses(spark):
    kl = column(spark, [0.2, 0.5, 1.0], lambda p: S.symmetric_kl(p, F.lit(0.5)), "double")
    assert kl[1] == 0 and kl[0] > 0 and np.isfinite(kl[2])
    assert column(spark, [0.0, 1.0, 0.5], S.entropy_bits, "double") == [0.0, 0.0, 1.0]


def test_hash_bits(spark):
    assert column(spark, ["ffffffffffffffff", "0000000000000001", "8000000000000000"], lambda c: S.hamming(S.hex_bits(c), F.lit(0).cast("long"))) == [64, 1, 1]


# Kernels


def image(seed=0, n=32):
    return np.random.default_rng(seed).random((n, n, 3))


def test_dct_is_orthonormal():
    m = kernels.dct_matrix(32)
    assert np.allclose(m @ m.T, np.eye(32))


def test_perceptual_hash_is_stable_under_small_changes():
    y, x = np.indices((64, 64)) / 64
    smooth = 0.5 + 0.3 * np.sin(3 * x) * np.cos(2 * y)
    a, b = kernels.perceptual_hash(smooth), kernels.perceptual_hash(np.clip(smooth + 0.002, 0, 1))
    c = kernels.perceptual_hash(kernels.gray(image(1, 64)))
    assert (a ^ b).bit_count() <= 4 and (a ^ c).bit_count() > 10


def test_quality_features_tell_blur_and_noise():
    base = kernels.gaussian_blur(image(2, 40), 2)
    plain, noisy, blurred = (kernels.quality_features(i) for i in (base, kernels.gaussian_noise(base, 0.1, 1), kernels.gaussian_blur(base, 2)))
    assert noisy[3] > plain[3] > blurred[3] and len(plain) == 6 and np.isfinite(plain).all()
    assert (kernels.quality_features(np.full((16, 16), 0.5)) == 0).all()


def test_transforms_keep_the_size_and_repeat():
    base = image(3, 24)
    for name, params in (("jpeg", {"quality": 50}), ("gaussian_blur", {"sigma": 1.0}), ("resize", {"scale": 0.5}), ("gaussian_noise", {"sigma": 0.05, "seed": 4}), ("color_jitter", {"brightness": 1.1, "contrast": 0.9, "saturation": 0.5}), ("center_crop", {"fraction": 0.8}), ("two", {"transforms": [{"name": "jpeg", "params": {"quality": 70}}, {"name": "gaussian_blur", "params": {"sigma": 0.5}}]})):
        a, b = (kernels.apply_transform(base, name, params, 5) for _ in range(2))
        assert a.shape == base.shape and (a == b).all() and a.min() >= 0 and a.max() <= 1, name
    assert (kernels.apply_transform(base, "gaussian_noise", {"sigma": 0.1}, 1) != kernels.apply_transform(base, "gaussian_noise", {"sigma": 0.1}, 2)).any()
    with pytest.raises(ValueError):
        kernels.apply_transform(base, "nope", {})


def test_strict_random_six_repeats_by_seed_and_row():
    base = image(4, 24)
    params = {"seed": 20260828, "profile": "full_training_range_v1"}
    first, second, other = (kernels.apply_transform(base, "strict_random_six", params, row) for row in (11, 11, 12))
    assert first.shape == base.shape and (first == second).all() and (first != other).any()
    for seed in range(200):
        steps = kernels.random_six(seed)
        assert [s["name"] for s in steps] == list(kernels.CHAIN_RANGES)
        assert 0.75 <= steps[0]["params"]["ratio"] <= 0.95 and 0.25 <= steps[1]["params"]["scale"] <= 0.75 and 30 <= steps[5]["params"]["quality"] <= 95
    with pytest.raises(ValueError, match="no ranges of the name"):
        kernels.apply_transform(base, "strict_random_six", {"seed": 1, "profile": "unknown"})


def test_jpeg_round_trip():
    assert kernels.quantisation(50, False)[0].tolist() == [16, 11, 10, 16, 24, 40, 51, 61] and kernels.quantisation(50, True)[4].tolist() == [99] * 8
    assert kernels.quantisation(100, False).tolist() == [[1] * 8] * 8 and kernels.quantisation(25, False)[0, 0] == 32 and kernels.quantisation(75, False)[0, 0] == 8
    base = image(6, 30)
    errors = [np.abs(kernels.jpeg_round_trip(base, q, 0) - np.round(base * 255) / 255).mean() for q in (100, 90, 50, 10)]
    assert errors == sorted(errors) and errors[0] < 0.006 < errors[3]
    flat = np.full((17, 19, 3), 100 / 255)
    assert (kernels.jpeg_round_trip(flat, 100) == flat).all()
    # brightness steps of a gray image: a flat block of 8 x 8 with value v has one coefficient, 8 (v - 128)
    assert kernels.jpeg_round_trip(np.full((8, 8), 100 / 255), 50)[0, 0] * 255 == 128 + round(8 * (100 - 128) / 16) * 16 / 8
    stripes = np.zeros((16, 16, 3))
    stripes[:, ::2] = (1, 0, 0)
    narrow, half = (kernels.jpeg_round_trip(stripes, 100, s) for s in (0, 2))
    assert np.abs(narrow - stripes).max() < 0.05 < np.abs(half - stripes).max()
    for bad in (0, 101):
        with pytest.raises(ValueError):
            kernels.jpeg_round_trip(base, bad)


def test_harmonised_images_have_one_format():
    for source in (image(7, 40), kernels.jpeg_round_trip(image(8, 33), 30)):
        first, second = (kernels.harmonised(source, 24, 90) for _ in range(2))
        assert first.shape == (24, 24, 3) and (first == second).all() and (np.round(first * 255) == first * 255).all()
    drawn = [kernels.training_quality(1, row) for row in range(400)]
    assert set(drawn) == {70, 80, 90, 95} and drawn == [kernels.training_quality(1, row) for row in range(400)]
    for bad in ((), (0,), (101,)):
        with pytest.raises(ValueError):
            kernels.training_quality(1, 1, bad)
    with pytest.raises(ValueError):
        kernels.harmonised(image(7, 8), 0)


def test_resampling_of_even_planes():
    x = np.full((9, 7), 0.25)
    for resize in kernels.RESIZES.values():
        assert np.allclose(resize(x, 5, 11), 0.25) and np.allclose(resize(kernels.gray(image(1, 6)), 6, 6), kernels.gray(image(1, 6)))


def test_chain_has_a_fixed_order_and_ranges():
    steps = kernels.chain({"jpeg": {"quality": 70}, "gaussian_noise": {"sigma": 0.02}, "center_crop": {"ratio": 0.8}, "gaussian_blur": {"sigma": 0.0}})
    assert [s["name"] for s in steps] == ["center_crop", "gaussian_blur", "gaussian_noise", "jpeg"] and steps[2]["params"] == {"sigma": 0.02, "seed": 20260827}
    assert kernels.apply_transform(image(3, 16), "chain", {"transforms": steps}).shape == (16, 16, 3) and kernels.chain({}) == []
    for bad in ({"jpeg": {"quality": 29}}, {"resize": {"scale": 1.1}}, {"color_jitter": {"hue": 1}}, {"sharpen": {}}):
        with pytest.raises(ValueError):
            kernels.chain(bad)


def test_augmentation_shares():
    n = [len(kernels.augmentation_policy(1, i, ("a", "b", "c"))) for i in range(4000)]
    assert abs(n.count(0) / 4000 - 0.25) < 0.03 and abs(n.count(2) / 4000 - 0.25) < 0.03


def test_patches_filters_and_maps():
    low, high = kernels.extreme_patches(np.hstack([np.full((16, 16), 0.5), kernels.gray(image(5, 16))]), 2)
    assert set(low.tolist()) <= {0, 1, 4, 5} and set(high.tolist()) <= {2, 3, 6, 7}
    bank = kernels.residual_filters()
    assert bank.shape == (30, 5, 5) and kernels.small_filters().shape == (8, 3, 3)
    for b in (bank, kernels.small_filters()):
        assert np.allclose(b.sum((1, 2)), 0) and np.allclose(np.abs(b).sum((1, 2)), 1)
    # the first: an impulse down, the first difference across; then its mean, zero, is taken off, and it is scaled
    assert bank[0][2].tolist() == [0, -0.5, 0, 0.5, 0] and not bank[0][[0, 1, 3, 4]].any()
    assert np.allclose(bank[1][2], [0, 0.25, -0.5, 0.25, 0]) and np.allclose(bank[8], bank[0].T)
    assert np.allclose(bank.sum((1, 2)), 0) and np.allclose(np.abs(bank).sum((1, 2)), 1)
    assert kernels.nearest_pixel_residual(np.full((5, 7), 0.3)).max() == 0
    heat = kernels.heat_map(np.arange(1000.0))
    assert heat.min() == 0 and heat.max() == 1


def test_gate():
    rng = np.random.default_rng(0)
    gates = kernels.softmax_gate(rng.random((10, 6)), rng.random((6, 32)), rng.random(32), rng.random((32, 2)), rng.random(2))
    assert np.allclose(gates.sum(1), 1)
    modes = kernels.gate_modes(gates, gates.mean(0), rng.permutation(10))
    assert set(modes) == {"learned", "equal", "clean_mean", "shuffled"} and np.allclose(modes["equal"], 0.5)


# Names of conditions, configurations


def test_condition_names():
    spec = {"name": "combo", "params": {"transforms": [{"name": "jpeg", "params": {"quality": 50, "seed": 3}}, {"name": "blur", "params": {"sigma": 1.0}}]}}
    assert src.transform_key(spec) == "jpeg__quality=50__blur__sigma=1.0"
    assert src.stage_text(spec) == "jpeg(quality=50) -> blur(sigma=1.0)"
    assert src.transform_key({"name": "clean"}) == "clean"


def test_configuration():
    assert src.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"c": 3}, "d": 4}) == {"a": {"b": 1, "c": 3}, "d": 4}
    assert src.canonical_digest({"b": 1, "a": 2}) == src.canonical_digest({"a": 2, "b": 1})
