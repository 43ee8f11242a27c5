"""Motion-JPEG files of other writers: frames of the JVM's encoder, of any size and with its own tables."""

import numpy as np

from palimpsest.llm import media


def jpegs(spark, grays, width, height, color=False):
    """Frames of one gray each (with a gradient where negative), by javax.imageio."""
    jvm = spark.sparkContext._jvm
    out = []
    for g in grays:
        image = jvm.java.awt.image.BufferedImage(width, height, 5 if color else 10)
        for y in range(height):
            for x in range(width):
                v = g if g >= 0 else (5 * x + 3 * y) % 256
                if color:
                    image.setRGB(x, y, v << 16 | v << 8 | v)
                else:
                    image.getRaster().setSample(x, y, 0, v)
        stream = jvm.java.io.ByteArrayOutputStream()
        assert jvm.javax.imageio.ImageIO.write(image, "jpg", stream)
        out.append(bytes(stream.toByteArray()))
    return out


def without_tables(frame):
    """The frame without its Huffman tables, as motion-JPEG cameras write it."""
    at, out = 2, frame[:2]
    while frame[at + 1] != 0xDA:
        n = 2 + int.from_bytes(frame[at + 2 : at + 4])
        out += b"" if frame[at + 1] == 0xC4 else frame[at : at + n]
        at += n
    return out + frame[at:]


def test_other_writers_files(spark):
    shots = [20] * 4 + [200] * 3
    files = [(1, media.write_avi(jpegs(spark, shots, 24, 19), 0).replace(b"payload=0", b"by others")), (2, media.write_avi([without_tables(f) for f in jpegs(spark, shots, 40, 24, True)], 0).replace(b"payload=0", b"by others")), (3, media.write_avi([jpegs(spark, [9], 24, 19)[0][:-40]], 0))]
    rows = {r.doc_id: r for r in media.read_avi(spark.createDataFrame([(i, 0, bytearray(f)) for i, f in files], "doc_id long, n_bytes long, media binary")).collect()}
    for i in (1, 2):
        assert rows[i].feature.startswith("frames=7;shots=2;cuts=4;") and rows[i].payload_sha256 is None
        assert [(c.first_frame, c.end_frame) for c in rows[i].clips] == [(0, 4), (4, 7)]
    assert rows[3].feature is None


def test_decoded_samples_are_the_pictures(spark):
    (gradient,) = jpegs(spark, [-1], 24, 19)
    _, planes = media.decode_frame(gradient)
    want = (5 * np.arange(24)[None] + 3 * np.arange(19)[:, None]) % 256
    assert planes[0].shape == (19, 24) and np.abs(planes[0].astype(int) - want).mean() < 5
    _, planes = media.decode_frame(jpegs(spark, [77], 40, 24, True)[0])
    assert [p.shape for p in planes] == [(24, 40), (12, 20), (12, 20)] and (np.abs(planes[0].astype(int) - 77) <= 1).all() and (planes[1] == 128).all()


def test_shots_are_cut_on_samples():
    data = np.random.default_rng(1).integers(1, 250, (3, media.FRAME_BYTES), dtype=np.uint8)
    for frame, samples in zip(media.code_frames(data), media.samples_of_bytes(data), strict=True):
        planes = media.decode_frame(frame)[1]
        assert np.sort(np.concatenate([p.ravel() for p in planes])).tolist() == np.sort(samples).tolist()
