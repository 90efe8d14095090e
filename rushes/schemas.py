"""Schemas of the observation tables, as DDL text for ``read.schema`` and ``createDataFrame``."""

from __future__ import annotations

BBOX = "struct<x:int,y:int,width:int,height:int>"

MEDIA_FILE = "file_id string, size long, modified timestamp, media_type string"
STREAM = (
    "struct<codec_type:string,codec_name:string,profile:string,pix_fmt:string,width:int,height:int,"
    "avg_frame_rate:string,r_frame_rate:string,bits_per_raw_sample:string,bits_per_sample:int,color_transfer:string,"
    "color_primaries:string,color_space:string,sample_rate:string,channels:int,bit_rate:string,"
    "side_data:string,tags:map<string,string>>"
)
PROBE = f"format struct<duration:string,bit_rate:string,tags:map<string,string>>, streams array<{STREAM}>"
METADATA = (
    "file_id string, duration double, width int, height int, video_codec string, profile string, pixel_format string, "
    "bit_depth int, fps double, bitrate long, audio_codec string, sample_rate int, channels int, audio_bitrate int, "
    "timecode string, created_at timestamp_ntz, gps struct<latitude:double,longitude:double,altitude:double>, "
    "color_space struct<transfer:string,primaries:string,matrix:string>, stereo_mode string"
)
TELEMETRY_POINT = (
    "file_id string, t double, recorded_at timestamp_ntz, latitude double, longitude double, altitude double, "
    "relative_altitude double, iso int, shutter double, aperture double, focal_length double, color_mode string"
)
GPS_POINT = "file_id string, idx long, latitude double, longitude double, altitude double"
KEYFRAME = "file_id string, t double"
MOTION_FRAME = "file_id string, t double, idx long, label string, intensity double"
SEGMENT = "file_id string, seg long, start double, end double, label string, intensity double"
SPEECH_FRAME = "file_id string, i long, samples array<smallint>"
TRANSCRIPT_SEGMENT = "file_id string, idx long, start double, end double, text string"
SPEAKER_TURN = "file_id string, idx long, start double, end double, speaker string"
DETECTION = f"file_id string, t double, idx long, label string, confidence double, bbox {BBOX}"
FACE_DETECTION = (
    f"file_id string, t double, idx long, confidence double, bbox {BBOX}, embedding array<double>, "
    "frame_width int, frame_height int"
)
OCR_DETECTION = "file_id string, t double, idx long, text string, confidence double, polygon array<struct<x:double,y:double>>"
EMBEDDING = "file_id string, t double, embedding array<double>"
MODEL_RESPONSE = "file_id string, t double, batch long, response string"
RUN_EVENT = (
    "batch_id string, file_id string, extractor string, resolution string, status string, started_at timestamp, "
    "seconds double, units double, memory_mb int"
)

# Accepted values.
DEVICE_TYPES = ["drone", "camera", "cinema_camera", "phone", "action_camera", "360_camera", "dashcam", "unknown"]
MEDIA_TYPES = ["video", "image", "audio", "unknown"]
STEREO_MODES = ["mvc", "side_by_side", "side_by_side_full", "top_bottom", "top_bottom_full", "unknown"]
