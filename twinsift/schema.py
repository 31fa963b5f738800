"""Types, categories and names that the engine fixes."""

from __future__ import annotations

from pyspark.sql import types as T

#: Suffixes of images, by family, and of videos.
RASTER_SUFFIXES = (
    "bmp cur gif ico jfif jpeg jpg jif jpe pbm pgm apng png ppm xbm xpm webp tif tiff svg svgz tga icns mng wbmp dib".split()
)
HEIF_SUFFIXES = "avif heic heif hif".split()
JPEG2000_SUFFIXES = "j2c j2k jp2 jpc jpf jpx".split()
RAW_SUFFIXES = (
    "3fr ari arw bay cap cr2 cr3 crw dcr dcs dng drf eip erf fff gpr iiq k25 kdc mdc mef mos mrw nef nrw orf pef ptx pxn r3d raf raw rw2 rwl rwz sr2 srf srw x3f".split()
)
VIDEO_SUFFIXES = (
    "3g2 3gp amv asf avi bik braw dav divx dv dvr-ms f4v flv m1v m2ts m2v m4v mkv mov mp4 mpe mpeg mpg mpv mts mxf ogm ogv qt rm rmvb ts vob webm wmv wtv y4m".split()
)
IMAGE_SUFFIXES = sorted({*RASTER_SUFFIXES, *HEIF_SUFFIXES, *JPEG2000_SUFFIXES, *RAW_SUFFIXES})

#: Codes are stable: dhash 0 to bhash 4 have a bit each in a hash mask, md5 5 has none.
ALGORITHMS = ("dhash", "phash", "ahash", "whash", "bhash", "md5")
DISPLAY_ORDER = ("md5", "ahash", "dhash", "whash", "bhash", "phash")
#: Codes, names and short names are fixed values; speeds and descriptions are this engine's words.
ALGORITHM_TABLE = [
    # code, name, short name, speed, description
    (0, "Difference Hash (dHash)", "dHash", "fastest of the image hashes", "Compares each pixel with its right neighbour: finds resized and recompressed copies."),
    (1, "Perceptual Hash (pHash)", "pHash", "slowest of the image hashes", "Keeps the coarse frequencies of a picture: bears changes of contrast and detail best."),
    (2, "Average Hash (aHash)", "aHash", "fastest of the image hashes", "Compares pixels with their average: simple, and quick to call different pictures alike."),
    (3, "Wavelet Hash (wHash)", "wHash", "fast", "Averages small blocks by a wavelet step: steadier than the average hash where there is noise."),
    (4, "BlockMean Hash (bHash)", "bHash", "fast", "Compares the means of blocks with their median: half of the bits are set, whatever the light."),
    (5, "Exact MD5 (byte-identical)", "MD5", "reads only files of shared sizes", "Finds files whose bytes are the same, of any kind."),
]

#: The digest of a file that could not be read; it is kept and never grouped.
ERROR_DIGEST = "error"
#: Files of this name are the engine's own and are never scanned.
CACHE_PREFIX = ".twinsift_cache."

CACHE_SCHEMA = T.StructType(
    [
        T.StructField("rel_path", T.StringType()),
        T.StructField("mtime", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        *(T.StructField(name, T.BinaryType()) for name in ALGORITHMS[:5]),
        T.StructField("md5", T.StringType()),
    ]
)
